"""An ordered set of (key, value) pairs, as a state DataFrame and an operation log (seq, op, key, value), op I or D."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.sources.storage import SharedFiles

PAIR = ["key", "value"]


def insert(state: DataFrame, rows: DataFrame, unique: bool = False) -> DataFrame:
    """The state with new pairs; with ``unique`` only of keys that have none (of several new ones the least value)."""
    if unique:
        rows = rows.groupBy("key").agg(F.min("value").alias("value"))
        return state.select(PAIR).unionByName(rows.join(state, "key", "left_anti").select(PAIR))
    return state.select(PAIR).unionByName(rows.select(PAIR).distinct().join(state, PAIR, "left_anti"))


def conditional_insert(state: DataFrame, rows: DataFrame, stops: Callable[[Column], Column]) -> DataFrame:
    """Inserts pairs whose key has no value for which ``stops`` holds."""
    blocked = state.where(stops(F.col("value"))).select("key").distinct()
    return insert(state, rows.join(blocked, "key", "left_anti"))


def delete(state: DataFrame, rows: DataFrame) -> DataFrame:
    return state.join(rows.select(PAIR).distinct(), PAIR, "left_anti").select(PAIR)


def lookup(state: DataFrame, key: int) -> DataFrame:
    return state.where(F.col("key") == key).select(PAIR)


def value_sets(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.sort_array(F.collect_set("value")).alias("values"))


def size(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("size"))


def ordered(state: DataFrame, start: int | None = None, reverse: bool = False) -> DataFrame:
    """Pairs from the first key at or after ``start`` on, in order of key and value; or all in reverse."""
    rows = state if start is None else state.where(F.col("key") >= start)
    return rows.select(PAIR).orderBy(*([F.desc("key"), F.desc("value")] if reverse else PAIR))


def neighbours(state: DataFrame, ranges: int = 64) -> DataFrame:
    """(key, before, after): each key's neighbours among the keys; null at the ends.

    Keys are dealt into ranges that hold about as many each, by approximate percentiles; a window holds a range, and the
    ranges' edges, one row each, give the neighbours across them.
    """
    keys = state.select("key").distinct()
    cuts = F.broadcast(keys.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts")))
    part = F.aggregate("cuts", F.lit(0), lambda n, cut: n + (F.col("key") > cut).cast("int"))
    keys = keys.crossJoin(cuts).select("key", part.alias("part"))
    w = W.partitionBy("part").orderBy("key")
    edges = keys.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("final"))
    over = W.orderBy("part")  # at most ``ranges`` rows
    edges = edges.select("part", F.lag("final").over(over).alias("left"), F.lead("first").over(over).alias("right"))
    near = keys.select("key", "part", F.lag("key").over(w).alias("b"), F.lead("key").over(w).alias("a"))
    return near.join(F.broadcast(edges), "part").select("key", F.coalesce("b", "left").alias("before"), F.coalesce("a", "right").alias("after"))


def replay(log: DataFrame) -> DataFrame:
    """The pairs that a log leaves: those whose last operation inserts."""
    last = log.groupBy("key", "value").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'I'").select(PAIR)


def success(log: DataFrame) -> DataFrame:
    """(seq, ok): an insert of a pair that is absent and a delete of one that is present succeed.

    After any operation the pair is as it says, whether it succeeded or not; so the one before decides.
    """
    return _judged(log).select("seq", "ok")


def _judged(log: DataFrame) -> DataFrame:
    w = W.partitionBy("key", "value").orderBy("seq")
    return log.select("seq", "op", (F.coalesce(F.lag("op").over(w), F.lit("D")) != F.col("op")).alias("ok"))


def replay_unique(log: DataFrame) -> DataFrame:
    """The pairs that a log leaves when a key holds one value: an insert into a held key and a delete of another value do nothing.

    The order of a key's operations matters, so each key's log is folded as one array.  Operations that
    repeat the one before on the same pair change nothing and go first, which bounds the array of a key by its changes.
    """
    w = W.partitionBy("key").orderBy("seq")
    same = (F.lag("op").over(w) == F.col("op")) & (F.lag("value").over(w) == F.col("value"))
    kept = log.withColumn("idle", F.coalesce(same, F.lit(False))).where("NOT idle")
    ops = F.array_sort(F.collect_list(F.struct("seq", "op", "value")))

    def step(held, x):
        return F.when((x["op"] == "I") & held.isNull(), x["value"]).when((x["op"] == "D") & (held == x["value"]), F.lit(None)).otherwise(held)

    folded = kept.groupBy("key").agg(ops.alias("ops")).select("key", F.aggregate("ops", F.lit(None).cast("long"), step).alias("value"))
    return folded.where("value IS NOT NULL")


def compacted(base: DataFrame, log: DataFrame) -> DataFrame:
    """The base with a later log applied."""
    first = base.select(F.lit(None).cast("long").alias("seq"), F.lit("I").alias("op"), *PAIR)
    rows = first.unionByName(log.select("seq", "op", *PAIR)).withColumn("seq", F.coalesce("seq", F.lit(-(2**63))))
    return replay(rows)


def compact(base: DataFrame, log: DataFrame, path: str, rows_of_file: int = 5_000_000) -> DataFrame:
    """Writes the compacted state sorted by key in ranges, so that lookups skip files and row groups; pairs of a key stay together."""
    out = compacted(base, log).repartitionByRange("key").sortWithinPartitions("key", "value")
    out.write.mode("overwrite").option("maxRecordsPerFile", rows_of_file).parquet(path)
    return base.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Thresholds:
    """When a segmented index is compacted: a log of over ``log_share`` of the base's rows, or over ``segments`` log segments."""

    log_share: float = 0.2
    segments: int = 16
    rows_of_file: int = 5_000_000


class SegmentedIndex:
    """An index kept as files of one folder: a base, log segments after it, and a pointer to what counts.

    Each change writes new files and then a new pointer, so readers of an older one are not disturbed until ``vacuum``
    removes what no pointer of the last ``keep`` names.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, thresholds: Thresholds = Thresholds()):
        self.spark, self.folder, self.thresholds = spark, folder.rstrip("/"), thresholds
        self.files = SharedFiles(spark, self.folder)

    def pointers(self) -> list[int]:
        return sorted(int(n.removeprefix("pointer-")) for n in self.files.names() if re.fullmatch(r"pointer-\d+", n))

    def held(self, number: int) -> dict:
        return json.loads(self.files.read(f"pointer-{number}"))

    def current(self) -> dict:
        found = self.pointers()
        return self.held(found[-1]) if found else {"base": None, "base_rows": 0, "segments": [], "log_rows": 0}

    def _point(self, held: dict) -> None:
        self.files.write(f"pointer-{(self.pointers() or [0])[-1] + 1}", json.dumps(held))

    def _log(self, held: dict) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/{n}" for n in held["segments"]]) if held["segments"] else None

    def state(self) -> DataFrame:
        held = self.current()
        base = self.spark.read.parquet(f"{self.folder}/{held['base']}") if held["base"] else self.spark.createDataFrame([], "key long, value long")
        log = self._log(held)
        return base if log is None else compacted(base, log)

    def append(self, log: DataFrame) -> bool:
        """Adds a later part of the log; compacts if that passes a threshold, and tells whether it did."""
        held, name = self.current(), f"segment-{uuid.uuid4().hex}"
        log.select("seq", "op", *PAIR).write.parquet(f"{self.folder}/{name}")
        rows = self.spark.read.parquet(f"{self.folder}/{name}").count()
        held = held | {"segments": [*held["segments"], name], "log_rows": held["log_rows"] + rows}
        self._point(held)
        limits = self.thresholds
        due = held["log_rows"] > limits.log_share * held["base_rows"] or len(held["segments"]) > limits.segments
        if due:
            self.compact()
        return due

    def compact(self) -> None:
        name = f"base-{uuid.uuid4().hex}"
        rows = compact(self.state(), self.spark.createDataFrame([], "seq long, op string, key long, value long"), f"{self.folder}/{name}", self.thresholds.rows_of_file).count()
        self._point({"base": name, "base_rows": rows, "segments": [], "log_rows": 0})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes bases, segments and pointers that none of the last ``keep`` pointers needs; returns their names."""
        found = self.pointers()
        stay = {f"pointer-{n}" for n in found[-keep:]}
        for n in found[-keep:]:
            held = self.held(n)
            stay |= {held["base"], *held["segments"]}
        gone = [n for n in self.files.names() if re.match("(base|segment|pointer)-", n) and n not in stay]
        for n in gone:
            self.files.remove(n)
        return sorted(gone)


def key_histogram(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count("*").alias("n"))


def counters(log: DataFrame) -> DataFrame:
    """Inserts and deletes, and how many of each succeeded."""
    one = lambda op, ok: F.count(F.when((F.col("op") == op) & (F.col("ok") if ok else F.lit(True)), 1))
    return _judged(log).agg(one("I", False).alias("inserts"), one("I", True).alias("inserted"), one("D", False).alias("deletes"), one("D", True).alias("deleted"))
