"""MinHash near-duplicates, with odd sketches that check banded candidates.

Each document's set of word shingles is folded into MinHash samples.  Bands of samples make
candidates; the parities of the samples' bits (an odd sketch) estimate, by the population count of
an XOR, how many samples differ, and reject hopeless candidates without their sets.  The full sets
then confirm every link.

No bucket is expanded into all pairs.  Documents with the same set are one class.  First each class
of a bucket is checked against the bucket's head only: the class that meets most others over all its
buckets, which in a group of edited copies is their original.  Classes that are then in one component
need no further link; in the second round only classes of one bucket that are still in different
components are compared, block by block, by the sketches and an exact bound: shingles that no other open class
has cannot be in an intersection.  Only pairs that pass become rows.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common

#: Bands of samples each; the sketch folds all samples, also those beyond the bands.
BANDS, ROWS, SAMPLES, BITS = 24, 4, 128, 512
#: The larger sketch of the second round.
MORE_SAMPLES, MORE_BITS = 1024, 4096
#: Rows of a block of a bucket; buckets of more than BLOCKS blocks have larger ones up to LARGE_BLOCK, since each row goes to all blocks.
BLOCK_ROWS, LARGE_BLOCK, BLOCKS = 512, 16384, 64
#: Pairs that are compared at once.
PAIRS = 1 << 15
SIGNATURE = "doc_id long, cls binary, n long, bands array<long>, sketch array<long>"


def _constants(n: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240601)
    return r.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, np.uint64)


def minhash(items: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    out = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    step = max(64, 2**18 // len(mul))
    for at in range(0, len(items), step):
        part = items[None, at : at + step] * mul[:, None]
        part += add[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """Keys of each row's bands; a key also holds its band's number."""
    k = len(samples)
    with np.errstate(over="ignore"):
        b = samples[:, : BANDS * ROWS].reshape(k, BANDS, ROWS)
        keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (k, 1))
        for i in range(ROWS):
            keys = common.mix(keys * common._P3 + b[:, :, i])
    return keys.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parities of how many of a row's samples fall on each bit."""
    k = len(samples)
    with np.errstate(over="ignore"):
        spot = common.mix(samples + np.arange(samples.shape[1], dtype=np.uint64) * common._P3) % np.uint64(bits)
    spot = spot.astype(np.int64) + np.arange(k)[:, None] * bits
    odd = (np.bincount(spot.ravel(), minlength=k * bits) & 1).astype(np.uint8).reshape(k, bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def longs(x: np.ndarray):
    """Rows of a matrix as an Arrow list."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Per document: its class (a digest of its whole set), the set's size, band keys and the odd sketch."""

    def run(batches):
        import pyarrow as pa

        mul, add = _constants()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cls, n, rows, samples = [], [], [], []
                for i, h in enumerate(common.hashed_words([common.lowered(t) for t in part.column(1).to_pylist()])):
                    s = common.shingles(h, shingle)
                    n.append(len(s))
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                    if len(s):
                        rows.append(i)
                        samples.append(minhash(s, mul, add))
                keys, sketch = np.zeros((len(n), BANDS), np.int64), np.zeros((len(n), BITS // 64), np.int64)
                if rows:
                    samples = np.array(samples)
                    keys[rows], sketch[rows] = band_keys(samples), odd_sketch(samples, BITS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), longs(keys), longs(sketch)], ["doc_id", "cls", "n", "bands", "sketch"])

    return common.texts(docs).mapInArrow(common.tidied(run), SIGNATURE)


def farthest(share: int, samples: int, bits: int) -> int:
    """The XOR population count that a pair at the limit passes only beyond six deviations (of samples and sketch together)."""
    j = share / 100
    m, v = samples * (1 - j), samples * j * (1 - j)
    p = (1 - math.exp(-4 * m / bits)) / 2
    return math.ceil(bits * p + 6 * math.sqrt(4 * math.exp(-8 * m / bits) * v + bits * p * (1 - p)))


def _close(share: int, samples: int = SAMPLES, bits: int = BITS):
    count = " + ".join(f"bit_count(sa[{i}] ^ sb[{i}])" for i in range(bits // 64))
    return F.expr(f"100 * least(na, nb) >= {share} * greatest(na, nb) AND {count} <= {farthest(share, samples, bits)}")


def near_duplicates(docs: DataFrame, shingle: int = 5, share: int = 80) -> DataFrame:
    """Groups documents whose shingle sets are linked: 100 * intersection >= share * union.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable),
    kept (doc_id equals component_id).  A text without words has an empty set and is linked with nothing:
    its component is its own doc_id.  A null text is empty.  Rows with a null doc_id are grouped too, but
    a null never is a component's smallest id unless it has no other; such a row is kept only then.
    Rows that repeat a doc_id all get the same answer if their sets do.  Very long texts are taken whole.  An empty table gives no rows.
    """
    sig = common.materialize(signatures(docs, shingle), "signatures")
    grouped = sig.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # the ids stay as written
    classes = common.materialize(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = classes.select(F.explode("bands").alias("key"), "id")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = common.materialize(rows.join(sizes, "key"), "members")
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    heads = members.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", F.negate("id").alias("minus"))).alias("best")).select("key", F.negate("best.minus").alias("head"))
    members = common.materialize(members.select("key", "id").join(heads, "key"), "headed")
    info = classes.select("id", "n", "sketch")

    def needed(ids: DataFrame) -> DataFrame:
        return common.materialize(classes.select("id", "cls", "doc_id").join(ids, "id", "left_semi"), "needed")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """(a, b) whose full sets confirm the link."""
        pairs = common.materialize(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        return common.materialize(common.similar(pairs, full_sets(common.with_ids(common.texts(docs), needed(ids)), shingle), share), "links")

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select(*[F.col(c).alias(x if c == "id" else c if c == "key" else c[0] + x) for c in df.columns])

    pairs = members.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    first = confirmed(pairs.join(side(info, "a"), "a").join(side(info, "b"), "b").where(_close(share)).select("a", "b"))
    parts = common.materialize(common.components(first), "parts")

    labelled = members.join(parts, members["id"] == parts["node"], "left").select("key", "id", "head", F.coalesce("label", "id").alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    # the head of a bucket has met all others
    open_ = common.materialize(labelled.where("id <> head").join(mixed, "key").select("key", "id", "part"), "open")
    mixed = open_.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("size")).where("x <> y").select("key", "size")
    open_ = common.materialize(open_.join(mixed, "key"), "open")
    sets = common.materialize(full_sets(common.with_ids(common.texts(docs), needed(open_.select("id").distinct())), shingle).dropDuplicates(["id"]), "sets")
    more = common.materialize(larger_sketches(sets).join(shared_counts(sets), "id").join(classes.select("id", "n", "bands"), "id"), "more")
    second = confirmed(compared(in_blocks(open_), more, share))

    labels = common.components(first.union(second))
    named = classes.select("id", "doc_id").join(labels, F.col("id") == F.col("node")).select("id", "label", "doc_id")
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("low"))
    named = named.join(lowest, "label").select("id", "low")
    alone = classes.select("id", "cls", "doc_id").join(named, "id", "left").select("cls", F.coalesce("low", "doc_id").alias("low"))
    out = sig.select("doc_id", "cls", "n").join(alone, "cls", "left")
    component = F.coalesce("low", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def in_blocks(members: DataFrame) -> DataFrame:
    """Members (key, size, id, part) of buckets, dealt to pairs (i, j) of blocks; ``own`` is a row's block.

    A row goes to as many pairs as its bucket has blocks, so that no group (key, i, j) exceeds about two blocks.
    """
    rows = F.greatest(F.lit(BLOCK_ROWS), F.least(F.lit(LARGE_BLOCK), F.ceil(F.col("size") / BLOCKS)))
    blocks = members.withColumn("blocks", F.ceil(F.col("size") / rows)).withColumn("own", F.expr("pmod(xxhash64(id), blocks)"))
    dealt = blocks.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "part")


def compared(dealt: DataFrame, more: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) of one bucket, of different parts, that sizes, shared items and larger sketches allow; each once, in its first common bucket.

    ``dealt`` is from ``in_blocks``, ``more`` has (id, sketch, common, n, bands).  Only pairs that pass become rows.
    """
    most, names = farthest(share, MORE_SAMPLES, MORE_BITS), ["key", "i", "j", "own", "id", "part", "n", "common"]

    def passing(c: dict[str, np.ndarray]):
        """The (a, b) of whole groups."""
        rows = len(c["id"])
        group = np.flatnonzero(np.concatenate([[True], (np.diff(c["key"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)]))
        last = np.repeat(np.append(group[1:], rows), np.diff(np.append(group, rows)))
        block = np.union1d(group, np.flatnonzero(np.diff(c["own"])) + 1)
        after = np.repeat(np.append(block[1:], rows), np.diff(np.append(block, rows)))
        # within one block the later rows, else the rows of the other block
        start = np.where(c["i"] == c["j"], np.arange(1, rows + 1), after)
        ends, at = np.cumsum(last - start), 0
        place = (c["bands"] == c["key"][:, None]).argmax(axis=1)
        while at < rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            many = (last - start)[at:to]
            u = np.repeat(np.arange(at, to), many)
            v = np.arange(len(u)) - np.repeat(np.cumsum(many) - many, many) + start[u]
            at = to
            low = np.minimum(c["common"][u], c["common"][v])
            ok = (c["part"][u] != c["part"][v]) & (100 * low >= share * (c["n"][u] + c["n"][v] - low))
            ok &= 100 * np.minimum(c["n"][u], c["n"][v]) >= share * np.maximum(c["n"][u], c["n"][v])
            u, v = u[ok], v[ok]
            ok = (c["bands"][u] == c["bands"][v]).argmax(axis=1) == place[u]
            u, v = u[ok], v[ok]
            ok = np.bitwise_count((c["sketch"][u] ^ c["sketch"][v]).view(np.uint64)).sum(axis=1) <= most
            yield c["id"][u[ok]], c["id"][v[ok]]

    def run(batches):
        import pyarrow as pa

        def out(c):
            for a, b in passing(c):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {x: batch.column(x).to_numpy() for x in names}
            c |= {x: batch.column(x).flatten().to_numpy().reshape(batch.num_rows, -1) for x in ("bands", "sketch")}
            if held:
                c = {x: np.concatenate([held[x], c[x]]) for x in c}
            # a batch may end within a group
            whole = np.flatnonzero((c["key"] != c["key"][-1]) | (c["i"] != c["i"][-1]) | (c["j"] != c["j"][-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield from out({x: y[:cut] for x, y in c.items()})
            held = {x: y[cut:] for x, y in c.items()}
        if held:
            yield from out(held)

    rows = dealt.join(more, "id").select(*names, "bands", "sketch").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")
    return rows.mapInArrow(common.tidied(run), "a long, b long")


def larger_sketches(sets: DataFrame) -> DataFrame:
    """(id, sketch): an odd sketch of more samples, for fewer sets."""

    def run(batches):
        import pyarrow as pa

        mul, add = _constants(MORE_SAMPLES)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                samples = np.array([minhash(np.frombuffer(x, np.uint64), mul, add) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), longs(odd_sketch(samples, MORE_BITS))], ["id", "sketch"])

    return sets.select("id", "items").mapInArrow(common.tidied(run), "id long, sketch array<long>")


def shared_counts(sets: DataFrame) -> DataFrame:
    """(id, common): how many items of each set some other set has too, at least."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["id", "item"])

    items = sets.select("id", "items").mapInArrow(common.tidied(run), "id long, item long")
    single = items.groupBy("item").agg(F.count("*").alias("size"), F.min("id").alias("id")).where("size = 1").groupBy("id").agg(F.count("*").alias("own"))
    sizes = sets.select("id", (F.octet_length("items") / 8).cast("long").alias("all"))
    return sizes.join(single, "id", "left").select("id", (F.col("all") - F.coalesce("own", F.lit(0))).alias("common"))


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, items) of rows (doc_id, text, id, cls): the whole set of shingle hashes, ascending, as bytes, where it is of class cls."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                items = [common.shingles(h, shingle).tobytes() for h in common.hashed_words([common.lowered(t) for t in part.column(2).to_pylist()])]
                keep = [xxhash.xxh3_128_digest(x) == c for x, c in zip(items, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], ["id", "items"]).filter(pa.array(keep, pa.bool_()))

    return docs.select("id", "cls", "text").mapInArrow(common.tidied(run), "id long, items binary")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    """See ``near_duplicates``, with shingles of three words and a similarity of 0.85."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=3, share=85)


#: The same rows by all pairs that share a shingle; for small tables.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)
), either AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, y FROM reach JOIN either ON other = x),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""
