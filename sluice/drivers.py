"""Load drivers: writers that update and scan registers for a time, and inserts and reads of many keys.

    python -m sluice.drivers registers [WRITERS] [SECONDS]
    python -m sluice.drivers index [KEYS] [ALPHA]

Writers do not share memory here: a round is one batch of writes of all writers, appended as files, and each then scans.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import generators, index, registers
from sluice.sources.storage import shared_path


def update_and_scan(spark: SparkSession, writers: int, seconds: float, batch: int = 100_000) -> tuple[DataFrame, float]:
    """Rounds of ``batch`` writes dealt to the writers, with a scan after each, for about so many seconds.

    Returns (tid, updates) of each writer and the seconds that all rounds took.
    """
    path, began, done = shared_path(spark, "rounds"), time.perf_counter(), 0
    while not done or time.perf_counter() - began < seconds:
        value = (generators.draw(F.col("id"), done) * float(1 << 52)).cast("long")
        spark.range(done * batch, (done + 1) * batch).select((F.col("id") + 1).alias("seq"), F.pmod("id", F.lit(writers)).alias("tid"), value.alias("value")).write.mode("append").parquet(path)
        registers.full_snapshot(spark, spark.read.parquet(path), writers).write.format("noop").mode("overwrite").save()
        done += 1
    return registers.update_counts(spark.read.parquet(path)), time.perf_counter() - began


def insert_and_read(spark: SparkSession, keys: int, alpha: float, reads: int | None = None) -> dict[str, float]:
    """Inserts that many pairs into an index, then reads keys drawn by Zipf's law (alpha 0: all alike); returns seconds and counts."""
    held = index.SegmentedIndex(spark, shared_path(spark, "driver"))
    began = time.perf_counter()
    held.append(spark.range(keys).select(F.col("id").alias("seq"), F.lit("I").alias("op"), F.col("id").alias("key"), F.col("id").alias("value")))
    inserted = time.perf_counter() - began
    ranks = min(keys, 10_000)  # as many groups of keys; within one all are alike
    drawn = generators.zipf(spark, reads or keys, 0, ranks - 1, alpha, 7)
    key = F.least(F.floor((F.col("v") + generators.draw(F.col("id"), 7, 3)) * (keys / ranks)).cast("long"), F.lit(keys - 1))
    began = time.perf_counter()
    found = drawn.select(key.alias("key")).join(held.state(), "key").agg(F.count("*").alias("n")).first().n
    return {"keys": keys, "alpha": alpha, "insert_s": inserted, "reads": reads or keys, "found": found, "read_s": time.perf_counter() - began}


def main(args: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    if args[:1] == ["registers"]:
        counts, took = update_and_scan(spark, int((args[1:2] or ["8"])[0]), float((args[2:3] or ["60"])[0]))
        rows = counts.orderBy("tid").collect()
        for r in rows:
            print(f"{r.tid}: {r.updates} updates")
        print(f"{sum(r.updates for r in rows)} updates in {took:.1f} s")
    elif args[:1] == ["index"]:
        print(insert_and_read(spark, int((args[1:2] or ["1000000"])[0]), float((args[2:3] or ["0"])[0])))
    else:
        sys.exit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
