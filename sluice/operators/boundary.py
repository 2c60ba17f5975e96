"""The boundary below which a log with concurrent writers is complete.

Slots are (pid, is_working, lsn); pid 0 is unclaimed.  The boundary is the least position that a working writer may still
be filling, at most the largest position written; 0 without writers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def active(slots: DataFrame) -> DataFrame:
    return slots.where("pid <> 0")


def boundary(slots: DataFrame) -> DataFrame:
    """One row ``rlb``."""
    busy = F.min(F.when(F.col("is_working"), F.col("lsn")))
    return active(slots).agg(F.coalesce(F.least(F.max("lsn"), busy), F.lit(0).cast("long")).alias("rlb"))


def write_events(writes: DataFrame, slots: int) -> DataFrame:
    """The log (seq, pid, is_working, lsn) of writes (start, finish, writer, lsn): each claims its writer's slot when it begins, with the
    position from which it may fill, and gives it back at its end, with the position up to which it has written.

    ``start`` and ``finish`` are places in time (all distinct), ``lsn`` the position before the write and ``written`` the one after.
    Slots are 1 to ``slots``, since pid 0 is unclaimed.
    """
    pid = (F.pmod("writer", F.lit(slots)) + 1).alias("pid")
    begin = writes.select(F.col("start").alias("seq"), pid, F.lit(True).alias("is_working"), F.col("lsn"))
    end = writes.select(F.col("finish").alias("seq"), pid, F.lit(False).alias("is_working"), F.col("written").alias("lsn"))
    return begin.unionByName(end)


def latest_slots(log: DataFrame) -> DataFrame:
    """The slots after a log (seq, pid, is_working, lsn): each writer's last row."""
    return log.groupBy("pid").agg(F.max_by("is_working", "seq").alias("is_working"), F.max_by("lsn", "seq").alias("lsn"))


def flush_pointers(requests: DataFrame, slots: DataFrame) -> DataFrame:
    """(request, flush): a flush goes to the boundary where that is further."""
    return requests.crossJoin(F.broadcast(boundary(slots))).select("request", F.greatest("request", "rlb").alias("flush"))


def timeline(log: DataFrame, every: int) -> DataFrame:
    """(cut, rlb) after all rows up to each multiple of ``every``.

    A row is its writer's state until the writer's next row, and covers the cuts in between.  That range falls into few aligned
    blocks of 2^level cuts; each block is aggregated once, and each cut then reads the blocks that it lies in.  So rows
    grow with the log and the cuts, not with writers times cuts.
    """
    w = W.partitionBy("pid").orderBy("seq")
    last = F.broadcast(active(log).agg(F.max("seq").alias("last")))
    rows = active(log).withColumn("next", F.lead("seq").over(w)).crossJoin(last)
    first = F.ceil(F.col("seq") / every)
    final = F.floor((F.coalesce("next", F.col("last") + 1) - 1) / every)
    states = rows.select(first.alias("a"), final.alias("b"), "is_working", "lsn").where("a <= b")
    # of each level the first and the last block that lies within a..b, if the block of twice the size does not
    inside = lambda level, i: f"(shiftleft({i}, {level}) >= a AND shiftleft({i} + 1, {level}) - 1 <= b)"
    of = lambda i: f"IF({i[1]} AND {inside('l', i[0])} AND NOT {inside('l + 1', f'shiftright({i[0]}, 1)')}, struct(l AS level, {i[0]} AS block), NULL)"
    low, high = "shiftright(a + shiftleft(1L, l) - 1, l)", "(shiftright(b + 1, l) - 1)"
    pair = f"array({of((low, 'true'))}, {of((high, f'{high} <> {low}'))})"
    used = states.withColumn("top", F.expr("least(38, cast(floor(log2(b - a + 1)) as int))"))
    blocks = used.select(F.explode(F.expr(f"filter(flatten(transform(sequence(0, top), l -> {pair})), x -> x IS NOT NULL)")).alias("x"), "is_working", "lsn")
    blocks = blocks.groupBy("x.level", "x.block").agg(F.max("lsn").alias("top"), F.min(F.when(F.col("is_working"), F.col("lsn"))).alias("busy"))
    most = F.broadcast(blocks.agg(F.max("level").alias("most")))
    ends = states.agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a IS NOT NULL")  # one row
    cuts = ends.select(F.explode(F.sequence("a", "b")).alias("k")).crossJoin(most).select("k", F.explode(F.sequence(F.lit(0), "most")).alias("level"))
    cuts = cuts.withColumn("block", F.expr("shiftright(k, level)"))
    found = cuts.join(blocks, ["level", "block"]).groupBy("k").agg(F.max("top").alias("top"), F.min("busy").alias("busy"))
    return found.select((F.col("k") * every).alias("cut"), F.least("top", "busy").alias("rlb"))
