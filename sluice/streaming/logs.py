"""The log operators as streams over the same files: state is kept per register, pair or writer, never per log row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import boundary
from sluice.sources.storage import shared_path


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """New files under the path, with the schema of those that are there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).format("parquet").load(path + "*")


def drained(result: DataFrame, tag: str) -> DataFrame:
    """Runs a stream over all that is there and returns its last complete result, as written to the shared folder."""
    spark = result.sparkSession
    out, marks = shared_path(spark, tag), shared_path(spark, tag + "-marks")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(out)

    query = result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def running_snapshot(log: DataFrame) -> DataFrame:
    """A stream of (tid, version, value)."""
    return log.groupBy("tid").agg(F.count("*").alias("version"), F.max_by("value", "seq").alias("value"))


def running_pairs(log: DataFrame) -> DataFrame:
    """A stream of (key, value, op): the last operation of each pair; those with I are present."""
    return log.groupBy("key", "value").agg(F.max_by("op", "seq").alias("op"))


def running_slots(log: DataFrame) -> DataFrame:
    return boundary.latest_slots(log)


def unique_pairs(log: DataFrame) -> DataFrame:
    """A stream of (key, value, seq): after each micro-batch the value that each touched key holds, if a key holds one value.

    The order of a key's operations matters, so the held value is the state of an Arrow-batched stateful operator.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, batches, state: GroupState):
        held, seq = state.get if state.exists else (None, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        for s, op, value in zip(rows["seq"], rows["op"], rows["value"]):
            if op == "I" and held is None:
                held = int(value)
            elif op == "D" and held == value:
                held = None
            seq = int(s)
        state.update((held, seq))
        yield pd.DataFrame({"key": pd.array([key[0]], "Int64"), "value": pd.array([held], "Int64"), "seq": pd.array([seq], "Int64")})

    return log.groupBy("key").applyInPandasWithState(fold, "key long, value long, seq long", "value long, seq long", "update", GroupStateTimeout.NoTimeout)


def drained_updates(result: DataFrame, tag: str, last: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs an update stream over all that is there; ``last`` reduces all updates to the final result."""
    spark = result.sparkSession
    out, marks = shared_path(spark, tag), shared_path(spark, tag + "-marks")

    def write(df: DataFrame, batch: int) -> None:
        # a repeated batch replaces its own folder
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return last(spark.read.schema(result.schema).parquet(f"{out}/batch=*"))
