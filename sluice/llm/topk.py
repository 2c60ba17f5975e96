"""Exact top-k search by inner product: tiles of queries and shards, selection per tile, merging per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm import common

#: Vectors of a shard block and of a query block; one tile has at most their product of scores.
SHARD_BLOCK, QUERY_BLOCK = 4096, 512
#: Query blocks of at most so many bytes go to every executor; beyond it query and shard blocks meet in the cells of a grid.
BROADCAST_BYTES = 64 << 20
#: Bytes of shard blocks of one cell of that grid.
CELL_BYTES = 256 << 20
LEAST, MOST = -(2**63), 2**63 - 1


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as a double that holds an integer.

    Rows whose vector or vec_id is null, or that hold a null or non-finite component, take no part (nor do those of which
    scale * x is no longer finite).  A vector without components takes part; its products are 0.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # floor() gives a long; doubles from 2^52 on are integers already
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(F.when(F.abs(x) < 2.0**52, x).otherwise(0.0)).cast("double")).otherwise(x))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).select("vec_id", whole.alias("v"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(dim, ids, mat): vectors of one length packed into blocks of at most ``size``, in ascending id order."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        open_: dict[int, list] = {}

        def block(dim, parts):
            ids, mat = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([mat[order].tobytes()], pa.binary())], ["dim", "ids", "mat"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat, offsets = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), batch.column(1).offsets.to_numpy()
            offsets = offsets - offsets[0]
            dims = np.diff(offsets)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                mat = flat[offsets[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                for i in range(0, len(at), size):
                    parts = open_.setdefault(dim, [])
                    parts.append((ids[at[i : i + size]], mat[i : i + size]))
                    if sum(len(p[0]) for p in parts) >= size:
                        yield block(dim, open_.pop(dim))
        for dim, parts in open_.items():
            yield block(dim, parts)

    return vectors.select("vec_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(common.tidied(pack), "dim int, ids binary, mat binary")


def products(q, r):
    """All inner products of two matrices of integers, exact: by floats or longs where these cannot round or overflow, else as Python integers."""
    import numpy as np

    dim = max(1, q.shape[1])
    peak = lambda m: np.abs(m).max(axis=1, initial=0.0)
    a, b = peak(q), peak(r)
    top = a.max(initial=0.0) * b.max(initial=0.0) * dim
    if top < 2**24:
        return (q.astype(np.float32) @ r.astype(np.float32).T).astype(np.int64)
    if top < 2**53:
        return (q @ r.T).astype(np.int64)
    # rows of small components meet in floats or longs; only what is left needs more
    kind = lambda peaks: np.where(peaks < (2**52 / dim) ** 0.5, 0, np.where(peaks < (2**62 / dim) ** 0.5, 1, 2))
    a, b = kind(a), kind(b)
    out = np.zeros((len(q), len(r)), object if max(a.max(initial=0), b.max(initial=0)) == 2 else np.int64)
    exact = lambda m, k: m if k == 0 else m.astype(np.int64) if k == 1 else np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    for i in range(3):
        for j in range(3):
            x, y, k = np.flatnonzero(a == i), np.flatnonzero(b == j), max(i, j)
            if len(x) and len(y):
                got = exact(q[x], k) @ exact(r[y], k).T if q.shape[1] else np.zeros((len(x), len(y)))
                out[np.ix_(x, y)] = got if k == 2 else got.astype(np.int64)
    return out


def beyond(score: int) -> str:
    """A text that orders scores outside a long among themselves, and after or before those that a long holds."""
    if LEAST <= score <= MOST:
        return "5"
    size, digits = len(str(abs(score))), str(abs(score))
    if score > 0:
        return f"9{size:06d}{digits}"
    return f"1{999999 - size:06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query vector the k rows of highest inner product, ties to the smaller vec_id.

    Both inputs are (vec_id, v) with vectors of integers (as longs or doubles).  Rows with the query's own vec_id are no
    candidates; vectors of another length neither.  A query vec_id that repeats counts once if its vectors are the same; candidates that
    repeat each count.  Without rows or queries there is no result; with fewer candidates than k, all are returned.
    The order is exact at any size; a score that no long holds is given as the nearest long.
    """
    shards = blocks(rows, SHARD_BLOCK)
    asked = blocks(queries.dropDuplicates(["vec_id", "v"]), QUERY_BLOCK)
    asked = asked.select(F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("mat").alias("qmat"))
    bytes_of = lambda df: df.agg(F.sum(F.size("v").cast("long") * 8 + 64)).first()[0] or 0
    size = bytes_of(queries)
    if size <= BROADCAST_BYTES:
        tiles = shards.join(F.broadcast(asked), F.col("dim") == F.col("qdim"))
    else:
        # each block goes to its own line of cells
        across, down = -(-size // BROADCAST_BYTES), max(1, -(-bytes_of(rows) // CELL_BYTES))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n - 1))))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(int(n))).cast("int")
        asked = asked.withColumn("qx", own("qids", across)).withColumn("qy", every(down))
        shards = shards.withColumn("x", every(across)).withColumn("y", own("ids", down))
        tiles = shards.join(asked.hint("merge"), (F.col("dim") == F.col("qdim")) & (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy")))

    def select(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for dim, ids, mat, qids, qmat in zip(*(c.to_pylist() for c in batch.columns)):
                ids, qids = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                r, q = np.frombuffer(mat).reshape(len(ids), dim), np.frombuffer(qmat).reshape(len(qids), dim)
                score = products(q, r)
                low, high = np.searchsorted(ids, qids, "left"), np.searchsorted(ids, qids, "right")
                out = []
                for i in range(len(qids)):
                    s, own = score[i], (int(low[i]), int(high[i]))
                    keep = np.ones(len(ids), bool)
                    keep[own[0] : own[1]] = False
                    at = np.flatnonzero(keep)
                    if len(at) > k:
                        limit = np.partition(s[at], len(at) - k)[len(at) - k]
                        above, tied = at[s[at] > limit], at[s[at] == limit]
                        at = np.concatenate([above, tied[: k - len(above)]])  # ids ascend within a block
                    out.append((np.full(len(at), i), at))
                row, at = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                best = score[row, at]
                if best.dtype == object:
                    more = pa.array(list(map(beyond, best.tolist())), pa.string())
                    best = np.array([min(MOST, max(LEAST, x)) for x in best.tolist()], np.int64)
                else:
                    more = pa.array(["5"] * len(at), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[at]), pa.array(best), more], ["query_id", "vec_id", "score", "more"])

    found = tiles.select("dim", "ids", "mat", "qids", "qmat").mapInArrow(common.tidied(select), "query_id long, vec_id long, score long, more string")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("more"), "vec_id")
    # Spark limits each partition to the best k of a query before it shuffles, then merges
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """See ``top_k``; empty tables, null vectors and repeated rows as there."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.e, r.e) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM t WHERE n <= 5
"""
