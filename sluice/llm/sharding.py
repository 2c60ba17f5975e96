"""Sharding by fixed virtual slots: records are hashed into thousands of slots, and a versioned map assigns slots to shards.

Everything is a DataFrame operation.  The map is a table (version, slot, shard, bytes, n_rows) in a folder of its own;
rebalancing appends a new version that moves slots, never single records.  Equal texts share a slot and so a shard,
but for a group of them that alone would unbalance the shards: that is dealt to several slots by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm import common

SLOTS = 4096
#: A slot that alone holds over 1/OVER of a shard's fair share is dealt out again into SPREAD slots by text; a text that does, into
#: slots of 1/PIECE of that by doc_id, at most MOST_PIECES.
OVER, SPREAD, PIECE, MOST_PIECES = 8, 64, 4, 4096


def sized(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash, slot) of each row; size is the text's UTF-8 bytes (null: none) plus 8.

    The slot comes from the text; see OVER for texts that are too heavy.  Rows that repeat a doc_id and text so often that they are too heavy go
    to further slots in turn, so that each gets as many however the input is partitioned.
    """
    text = F.col("text").cast("string")
    raw = text.cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.spark_partition_id().alias("pid"),
    )
    rows = common.materialize(rows.withColumn("slot", F.pmod("text_hash", F.lit(slots)).cast("int")), "sized")
    total = F.broadcast(rows.agg(F.sum("size").alias("total")))
    too_much = f"n > 1 AND bytes * {shards * OVER} > total"  # of fewer than shards * OVER
    pieces = F.least(F.lit(MOST_PIECES), F.ceil(F.col("bytes") * (PIECE * shards * OVER) / F.col("total"))).cast("int")

    def heavy(df: DataFrame, *by: str) -> DataFrame:
        sums = df.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).crossJoin(total).where(too_much)
        return F.broadcast(common.materialize(sums.select(*[F.col(c).alias("h_" + c) for c in by], pieces.alias("pieces_of_" + by[-1])), "heavy"))

    def joined(df: DataFrame, right: DataFrame, *by: str) -> DataFrame:
        out = df.join(right, [F.col(c).eqNullSafe(F.col("h_" + c)) for c in by], "left")
        return out.drop(*["h_" + c for c in by])

    marked = joined(rows, heavy(rows, "slot"), "slot")
    marked = joined(marked, heavy(marked.where("pieces_of_slot IS NOT NULL"), "slot", "text_hash"), "slot", "text_hash")
    same = heavy(marked.where("pieces_of_text_hash IS NOT NULL"), "slot", "text_hash", "doc_id")
    marked = joined(marked, same, "slot", "text_hash", "doc_id")
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("pieces_of_text_hash"))
    own = F.lit(slots) + F.col("slot") * (SPREAD + MOST_PIECES)
    by_text = own + F.pmod(F.xxhash64("text_hash", F.lit(1)), F.lit(SPREAD))
    plain = marked.where("pieces_of_doc_id IS NULL").withColumn("to", F.when(F.col("pieces_of_slot").isNull(), F.col("slot")).when(F.col("pieces_of_text_hash").isNull(), by_text).otherwise(own + SPREAD + place))
    # rows that repeat very often are numbered within each task, then across tasks
    key = ["slot", "text_hash", "doc_id"]
    often = marked.where("pieces_of_doc_id IS NOT NULL").withColumn("nth", F.row_number().over(W.partitionBy(*key, "pid").orderBy("size")))
    starts = often.groupBy(*key, "pid").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.select(*[F.col(c).alias("s_" + c) for c in (*key, "pid")], "start")
    often = often.join(starts, [F.col(c).eqNullSafe(F.col("s_" + c)) for c in (*key, "pid")])
    often = often.withColumn("to", own + SPREAD + F.pmod(F.col("start") + F.col("nth"), F.least("pieces_of_doc_id", "pieces_of_text_hash")))
    columns = ["doc_id", "size", "text_crc32", "text_hash", F.col("to").cast("int").alias("slot")]
    out = plain.select(columns)
    return out if same.isEmpty() else out.unionByName(often.select(columns))


def slot_loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def _replace(values: Column, at: Column, new) -> Column:
    return F.transform(values, lambda v, i: F.when(i == at, new(v)).otherwise(v))


def balanced_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, slot, shard, bytes, n_rows): the heaviest slot first, each to the shard that is lightest so far.

    One row folds a number of slots that is bounded by SLOTS, shards and OVER, whatever the input's size.
    """
    one = loads.agg(F.array_sort(F.collect_list(F.struct(F.negate("bytes").alias("minus"), "slot", "n_rows"))).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("picks"))

    def step(acc, x):
        at = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(_replace(acc["loads"], at, lambda v: v - x["minus"]).alias("loads"), F.concat(acc["picks"], F.array(at)).alias("picks"))

    one = one.select("slots", F.aggregate("slots", start, step)["picks"].alias("picks"))
    each = one.select(F.explode(F.arrays_zip("slots", "picks")).alias("x"))
    return each.select(F.lit(version).alias("version"), F.col("x.slots.slot").alias("slot"), F.col("x.picks").alias("shard"), F.negate("x.slots.minus").alias("bytes"), F.col("x.slots.n_rows").alias("n_rows"))


def with_one_more(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, with one more shard: slots move only into it, from shards above the new fair share."""
    one = slot_map.agg(F.array_sort(F.collect_list(F.struct(F.negate("bytes").alias("minus"), "slot", "shard", "n_rows"))).alias("slots"), F.max("version").alias("version"))
    total = F.negate(F.aggregate("slots", F.lit(0).cast("long"), lambda a, x: a + x["minus"]))
    one = one.withColumn("fair", (total / (shards + 1)).cast("long"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.negate(F.aggregate(F.filter("slots", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda a, x: a + x["minus"])))
    start = F.struct(loads.alias("loads"), F.lit(0).cast("long").alias("got"), F.array().cast("array<int>").alias("picks"))

    def step(acc, x):
        at = x["shard"]
        move = (F.get(acc["loads"], at) + x["minus"] >= F.col("fair") * 0.98) & (acc["got"] - x["minus"] <= F.col("fair"))
        return F.struct(
            _replace(acc["loads"], at, lambda v: F.when(move, v + x["minus"]).otherwise(v)).alias("loads"),
            F.when(move, acc["got"] - x["minus"]).otherwise(acc["got"]).alias("got"),
            F.concat(acc["picks"], F.array(F.when(move, F.lit(shards)).otherwise(at))).alias("picks"),
        )

    one = one.select("slots", "version", F.aggregate("slots", start, step)["picks"].alias("picks"))
    each = one.select("version", F.explode(F.arrays_zip("slots", "picks")).alias("x"))
    return each.select((F.col("version") + 1).alias("version"), F.col("x.slots.slot").alias("slot"), F.col("x.picks").alias("shard"), F.negate("x.slots.minus").alias("bytes"), F.col("x.slots.n_rows").alias("n_rows"))


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of a map for the present loads (slot, bytes, n_rows): slots that are new, or on a shard that is over its
    fair share by more than ``slack``, go to the lightest shard if that helps; all others stay."""
    known = slot_map.select(F.col("slot").alias("known"), "shard")
    held = loads.join(known, F.col("slot") == F.col("known"), "left").withColumn("shard", F.coalesce("shard", F.lit(-1)))
    one = held.agg(F.array_sort(F.collect_list(F.struct(F.negate("bytes").alias("minus"), "slot", "shard", "n_rows"))).alias("slots")).crossJoin(slot_map.agg(F.max("version").alias("version")))
    weight = lambda keep: F.negate(F.aggregate(F.filter("slots", keep), F.lit(0).cast("long"), lambda a, x: a + x["minus"]))
    one = one.withColumn("most", weight(lambda x: F.lit(True)) / shards * (1 + slack))
    start = F.struct(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: weight(lambda x: x["shard"] == s)).alias("loads"), F.array().cast("array<int>").alias("picks"))

    def step(acc, x):
        own = F.get(acc["loads"], x["shard"])
        least = F.array_min(acc["loads"])
        move = (x["shard"] < 0) | (x["shard"] >= shards) | ((own > F.col("most")) & (least - x["minus"] < own))
        at = F.when(move, F.array_position(acc["loads"], least) - 1).otherwise(x["shard"]).cast("int")
        gone = F.transform(acc["loads"], lambda v, i: F.when(move & (i == x["shard"]), v + x["minus"]).when(move & (i == at), v - x["minus"]).otherwise(v))
        return F.struct(gone.alias("loads"), F.concat(acc["picks"], F.array(at)).alias("picks"))

    one = one.select("slots", "version", F.aggregate("slots", start, step)["picks"].alias("picks"))
    each = one.select("version", F.explode(F.arrays_zip("slots", "picks")).alias("x"))
    return each.select((F.col("version") + 1).alias("version"), F.col("x.slots.slot").alias("slot"), F.col("x.picks").alias("shard"), F.negate("x.slots.minus").alias("bytes"), F.col("x.slots.n_rows").alias("n_rows"))


def store_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Appends a version to the folder; one that is there already is an error."""
    slot_map.drop("version").write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest by default."""
    every = spark.read.parquet(path)
    found = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == found).select("version", "slot", "shard", "bytes", "n_rows")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with shard and position: the place within the shard, without gaps from 0 (by slot, then doc_id, size, crc, hash).

    A window holds the rows of one virtual slot; the map gives how many rows stand before it in its shard.
    """
    before = W.partitionBy("shard").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    base = slot_map.withColumn("base", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).select("slot", "shard", "base")
    own = W.partitionBy("slot").orderBy("doc_id", "size", "text_crc32", "text_hash")
    numbered = rows.withColumn("nth", F.row_number().over(own))
    return numbered.join(F.broadcast(base), "slot").withColumn("position", F.col("base") + F.col("nth") - 1)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``bytes``; here slot is the place within the shard, gapless from 0.

    Null texts have size 8 and crc32 0; rows with a null doc_id, and rows that repeat, are placed like all others.  An empty
    table gives no rows.
    """
    rows = common.materialize(sized(common.table(spark, sf_dir, "documents"), 24), "slots")
    path = common.new_path(spark, "slot-map")
    store_map(balanced_map(slot_loads(rows), 24), path, 1)
    out = assign(rows, load_map(spark, path))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
