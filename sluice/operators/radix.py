"""How keys fall into partitions: sizes and where each begins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, key: str, parts: int = 32) -> DataFrame:
    return df.groupBy(F.pmod(F.col(key), F.lit(parts)).cast("long").alias("part")).agg(F.count("*").alias("n"))


def offsets(df: DataFrame, key: str, parts: int = 32) -> DataFrame:
    """The histogram with an exclusive running total; the window holds at most ``parts`` rows."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return histogram(df, key, parts).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
