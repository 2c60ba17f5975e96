"""Byte-level BPE encoding by overlapping chunks, and decoding.

A long text is cut into overlapping chunks, which are pre-tokenised in parallel.  A match of the pattern depends
only on what stands from its start on, so where two neighbouring chunks both begin a match, all later
matches agree: the text is cut at the first such point of each overlap, and the pieces are encoded in parallel.
Chunks begin before a word, where ordinary text always has such a point, if there is one within a chunk's length (so a run of letters or
of white space at a cut moves the cut).  From an overlap without a common point on, the text stays one piece.
Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm import common

#: Code points of a chunk, and of what it shares with the next.
CHUNK, OVERLAP = 16384, 512
#: Between two words: chunks begin here if they can.  It only makes cuts likely to fit; whether they do is seen in the overlaps.
BETWEEN = r"(?<=[^\W\d_]) (?=[^\W\d_])"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def boundaries(part: str, low: int, high: int, pattern: str, last: bool) -> list[int]:
    """Starts of matches in [low, high] which text beyond the part cannot change.

    A match looks at most two code points past its end and three past its start.
    """
    import regex

    out, n = [], len(part)
    for m in regex.finditer(pattern, part):
        if m.start() > high or not last and (m.start() + 3 > n or m.end() + 2 > n):
            if m.start() <= high and m.start() >= low and m.start() == 0:
                out.append(0)
            break
        if m.start() >= low:
            out.append(m.start())
    return out


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row's whole text; ids are little-endian unsigned 32-bit integers.

    A null or empty text gives no ids.  Rows that repeat a doc_id, or have none, each give a row.  The file at
    ``path`` must be readable on each executor.  An empty table gives no rows.
    ``decoded`` adds what ``decode`` gives, without a second Python process for each task.
    """
    rows = common.texts(docs).withColumn("row", F.monotonically_increasing_id())

    def encoder():
        import numpy as np
        import tiktoken

        one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
        return lambda t: np.array(one.encode_ordinary(t), "<u4").tobytes()

    def whole(batches):
        import pyarrow as pa

        to_ids, to_bytes = encoder(), decoder(path) if decoded else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [to_ids(t) for t in part.column(1).to_pylist()]
                more = [pa.array(map(to_bytes, ids), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), *more], ["doc_id", "ids", "decoded"][: 2 + len(more)])

    def cut(batches):
        import re

        import pyarrow as pa

        between = re.compile(BETWEEN)
        for batch in batches:
            for doc_id, text, row in zip(*(c.to_pylist() for c in batch.columns)):
                starts = [0]
                while (x := starts[-1] + chunk) < len(text):
                    found = between.search(text, x, x + chunk)
                    starts.append(found.start() if found else x)
                sizes = [b - a for a, b in zip(starts, [*starts[1:], len(text)])]
                for i in range(0, len(starts), 64):
                    s, n = starts[i : i + 64], sizes[i : i + 64]
                    columns = [pa.array([row] * len(s), pa.int64()), pa.array([doc_id] * len(s), pa.int64()), pa.array(s, pa.int64()), pa.array([text[x : x + k + overlap] for x, k in zip(s, n)]), pa.array([x + k + overlap >= len(text) for x, k in zip(s, n)]), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "at", "part", "last", "size"])

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            heads, tails = [], []
            for at, part, last, size in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                found = boundaries(part, 0, len(part), pattern, last)
                heads.append([at + x for x in found if x <= overlap])
                # a piece must not end in white space that the match before it would then take
                tails.append([at + x for x in found if x >= size and not part[x - 1].isspace()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*batch.schema.names, "heads", "tails"])

    long_ = rows.where(F.length("text") > chunk).select("doc_id", "text", "row").mapInArrow(common.tidied(cut), "row long, doc_id long, at long, part string, last boolean, size long")
    spread = long_.repartition(F.xxhash64("row", "at"))
    spread = spread.mapInArrow(common.tidied(split), "row long, doc_id long, at long, part string, last boolean, size long, heads array<long>, tails array<long>")
    w = W.partitionBy("row").orderBy("at")
    nxt = F.array_min(F.array_intersect("tails", F.lead("heads").over(w)))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    # a chunk that has not met the text before it may be out of step to its end
    found = spread.withColumn("next", nxt).withColumn("next", F.when(F.min(F.col("next").isNotNull()).over(so_far), F.col("next"))).withColumn("start", F.lag("next").over(w)).withColumn("end", F.coalesce("next", F.lead("at").over(w)))
    # without a common point the pieces on both sides belong together
    found = found.withColumn("run", F.sum(F.when(F.col("start").isNull(), 0).otherwise(1)).over(so_far))
    first = F.coalesce("start", "at")
    piece = F.expr("substring(part, int(coalesce(start, at) - at) + 1, int(coalesce(end, at + length(part)) - coalesce(start, at)))")
    pieces = found.select("row", "doc_id", "run", first.alias("first"), piece.alias("piece"))
    pieces = pieces.groupBy("row", "run").agg(F.min("doc_id").alias("doc_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "piece"))), lambda x: x["piece"]), "").alias("piece"))

    def by_piece(batches):
        import pyarrow as pa

        to_ids = encoder()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([to_ids(t).hex() for t in batch.column(3).to_pylist()])], ["row", "doc_id", "run", "ids"])

    encoded = pieces.select("row", "doc_id", "run", "piece").mapInArrow(common.tidied(by_piece), "row long, doc_id long, run long, ids string")
    joined = encoded.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda x: x["ids"]), "")).alias("ids"))
    short = rows.where(F.length("text") <= chunk).select("doc_id", "text").mapInArrow(common.tidied(whole), "doc_id long, ids binary" + ", decoded binary" * decoded)
    joined = joined.select("doc_id", "ids")
    out = short.unionByName(decode(joined, path) if decoded else joined)
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decoder(path: str):
    """A function from raw ids to the concatenated bytes of their tokens."""
    import numpy as np

    table = {b: a for a, b in ranks_of(path).items()}
    return lambda ids: b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with one more column, decoded: the raw bytes of its ids' tokens, concatenated.  An unknown id is an error."""
    names = encoded.columns

    def run(batches):
        import pyarrow as pa

        to_bytes = decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = list(map(to_bytes, part.column(names.index("ids")).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(common.tidied(run), ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded binary")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Numbers of ids and digests of ids and decoded bytes; nulls, empty and long texts, repeated rows and empty tables as in ``encode``."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = encode(common.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
