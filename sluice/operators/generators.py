"""Seeded workloads: uniform and Zipf integers, their probabilities, and histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(i: Column, seed: int, stream: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the row's number and the seed only: 52 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), i.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def uniform(spark: SparkSession, rows: int, low: int, high: int, seed: int) -> DataFrame:
    """``rows`` values of low to high; the same seed gives the same ones, however they are partitioned."""
    return spark.range(rows).select("id", (F.floor(draw(F.col("id"), seed) * (high - low + 1)) + low).cast("long").alias("v"))


def gaussian(spark: SparkSession, rows: int, mean: float, deviation: float, seed: int) -> DataFrame:
    """``rows`` normal values, each from two draws."""
    a, b = draw(F.col("id"), seed, 1), draw(F.col("id"), seed, 2)
    return spark.range(rows).select("id", (F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * math.pi * b) * deviation + mean).alias("v"))


def zipf_probabilities(spark: SparkSession, n: int, alpha: float) -> DataFrame:
    """(i, p, cdf) of i = 1 to n with p in proportion to i to the power -alpha.  The table has n rows; n is a bound that the caller sets."""
    rows = spark.range(1, n + 1).select(F.col("id").alias("i"), F.pow(F.col("id").cast("double"), F.lit(-float(alpha))).alias("w"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = W.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("i", (F.col("w") / F.sum("w").over(every)).alias("p"), (F.sum("w").over(upto) / F.sum("w").over(every)).alias("cdf"))


def _first_at_least(cdf: Column, u: Column, n: int) -> Column:
    """1-based place of the first cdf >= u, by halving."""
    start = F.struct(F.lit(1).alias("lo"), F.lit(n).alias("hi"))

    def step(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        up = F.get(cdf, mid - 1) < u
        return F.struct(F.when(up, F.least(mid + 1, a["hi"])).otherwise(a["lo"]).alias("lo"), F.when(up, a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))), start, step)["lo"]


def zipf(spark: SparkSession, rows: int, low: int, high: int, alpha: float, seed: int) -> DataFrame:
    """``rows`` values of low to high, the i-th of them in proportion to i to the power -alpha."""
    n = high - low + 1
    table = zipf_probabilities(spark, n, alpha).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "cdf"))), lambda x: x["cdf"]).alias("cdf"))
    drawn = spark.range(rows).select("id", draw(F.col("id"), seed).alias("u"))
    return drawn.crossJoin(F.broadcast(table)).select("id", (_first_at_least(F.col("cdf"), F.col("u"), n) - 1 + low).cast("long").alias("v"))


def histogram(values: DataFrame, per_mark: int = 10) -> DataFrame:
    """(v, n, bar)."""
    return values.groupBy("v").agg(F.count("*").alias("n")).withColumn("bar", F.expr(f"repeat('*', int(n div {per_mark}))"))


def short_size(n: int) -> str:
    """8192 as 8K."""
    for unit in ("", "K", "M", "G", "T"):
        if n < 1024 or n % 1024:
            return f"{n}{unit}"
        n //= 1024
    return f"{n}P"
