"""A corpus pipeline over the table of documents: toxicity, line dedup, near-dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All stages but the last return the columns of documents, whatever others a table has besides doc_id and text and
whatever their names.  In every stage a null text is an empty one (and stays null where it is kept), rows may lack a
doc_id or repeat one, texts are taken whole at any length, and an empty table gives an empty one.

The order of the stages is given.  Line dedup leaves hardly a near copy to the stage after it: of two near copies the later one has lost
the lines that they share.  Near-dedup then finds what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, common, decontaminate, line_dedup, near_dedup, toxicity

REJECT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches REJECT go.

    A text without words has the score of the model's bias; rows that repeat go or stay together.  Without labels of both kinds each
    row has the share of the toxic ones as its score.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    column = common.free(docs, "__toxicity")
    scored = toxicity.score(docs, model, column)
    return scored.where(F.col(column) < REJECT).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go (by doc_id, then place; rows without a doc_id first); a document that has lost all of them goes too.

    Texts without lines stay as they are.  Rows that repeat a doc_id and text are one document: each loses what an earlier document has, and
    what stands twice in itself.
    """
    return line_dedup.dedup_lines(docs)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, and the key's name: a 64-bit hash of its doc_id, which may be null or repeat, and its text."""
    name = common.free(docs, "__key")
    rows = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn(name, rows), name


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8) stays: one of the smallest doc_id, null last.

    Rows are told apart by doc_id and text: a null id is no id to join on, and each text of a repeated id has its own group.  Of
    rows that repeat both one stays.  Texts without words are in no group and all stay.
    """
    rows, key = keyed(docs)
    found = near_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), shingle=5, share=80).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias(key)).agg(F.first("component_id").alias("component"), F.count("*").alias("times"))
    found = common.materialize(found, "found")
    ids = rows.select(key, F.col("doc_id").cast("long").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key).alias("key")))
    stay = ids.join(found, key).groupBy("component").agg(first.alias("first")).select(F.col("first.key").alias(key))
    gone = common.materialize(found.select(key).join(stay, key, "left_anti"), "gone")
    out = rows.join(gone, key, "left_anti")
    again = found.where("times > 1").select(key)
    if not again.isEmpty():
        out = out.join(again, key, "left_anti").unionByName(out.join(again, key, "left_semi").dropDuplicates([key]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; rows are told apart by doc_id and text, as above, so rows that repeat both go or stay together.

    Items without words match nothing; an empty benchmark leaves all rows.
    """
    rows, key = keyed(docs)
    found = decontaminate.matches(rows.select(F.col(key).alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its byte-level BPE ids (little-endian unsigned 32-bit integers), their number and digest, and the digest of the decoded bytes.

    A null or empty text has none; each row gives a row.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("bpe", token_ids),
]
#: Learned scores and exact set joins cannot be given in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table of documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
