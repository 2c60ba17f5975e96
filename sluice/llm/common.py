"""What the operators share: shared folders, word hashing, candidate checks, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A set of keys of at most so many rows goes to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def work_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="sluice-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/sluice-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes the rows to the shared folder and reads them again."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch: texts may be long, and both the JVM and the Python process hold a batch whole.
BATCH_ROWS = 2000
#: Bytes of one Arrow batch: packed rows are large, and a batch of all rows of a task would be held twice whole.
BATCH_BYTES = 8 << 20


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of each row; a null text is an empty one.

    Lowers Spark's default numbers of rows and bytes in an Arrow batch, which are read when a plan runs and so stay lowered in this session; other numbers that
    the session has are kept.
    """
    conf, rows, size = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(rows) == "10000":
        conf.set(rows, str(BATCH_ROWS))
    if conf.get(size, None) is None:
        conf.set(size, str(BATCH_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def free(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """(doc_id, key, text, y) of labelled rows to learn from: texts of at most ``most`` doc_ids, those whose hashes come first.

    ``held_out`` tells of a doc_id whether its label must not be seen.  A doc_id with labels of both kinds is not learned from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", F.xxhash64("text").alias("key"), "text", "y")


def one_each(measured: DataFrame, columns: list[str]):
    """The ``columns`` of one row of each doc_id as an Arrow table: of texts that repeat a doc_id, the one of the least key."""
    first = measured.groupBy("doc_id").agg(F.min_by(F.struct(*columns), "key").alias("r"))
    return first.orderBy("doc_id").select("r.*").toArrow()


def tidy() -> None:
    """Gives free memory of this Python process back; Spark keeps the process for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run):
    """``run`` for mapInArrow, with ``tidy`` after a task's last batch."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


# -- words and shingles ---------------------------------------------------------------------

_MASK = np.uint64
_P1, _P2, _P3 = _MASK(0xBF58476D1CE4E5B9), _MASK(0x94D049BB133111EB), _MASK(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = (h ^ (h >> _MASK(30))) * _P1
    h = (h ^ (h >> _MASK(27))) * _P2
    return h ^ (h >> _MASK(31))


#: Words are hashed by the polynomial of random byte values, in blocks of about so many bytes.
BLOCK = 1 << 17
_BASE = 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(9176).integers(0, 2**64, 256, np.uint64)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; only the table of the usual size is kept."""
    if size <= 2 * BLOCK and (held := _powers.get(0)) is not None:
        return held
    n = max(size, 2 * BLOCK)
    made = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 2**64)))
    if n == 2 * BLOCK:
        _powers[0] = made
    return made


def _stripped(data: bytes, a: np.ndarray, begin: np.ndarray, stop: np.ndarray, edges: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words without the given bytes at their ends; ones that hold no others go."""
    mark = np.zeros(256, bool)
    mark[list(edges)] = True
    for step, last in ((1, False), (-1, True)):
        place = stop if last else begin
        at = np.flatnonzero((stop > begin) & mark[a[np.maximum(place - last, 0)]])
        for _ in range(32):
            place[at] += step
            at = at[stop[at] > begin[at]]
            at = at[mark[a[place[at] - last]]]
        for i in at.tolist():  # longer runs of marks
            word = data[begin[i] : stop[i]]
            place[i] += step * (len(word) - len(word.rstrip(edges) if last else word.lstrip(edges)))
    keep = stop > begin
    return begin[keep], stop[keep]


def word_hashes(data: bytes, edges: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than ASCII white space) and where each begins; case counts.

    With ``edges``, words are taken without these bytes at their ends, and words of such bytes only stay out.  Memory is bounded by blocks, which end at white space; only a longer word makes a longer block.
    """
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        cut = _SPACE.search(data, at + BLOCK)
        end = cut.start() if cut else len(data)
        a = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = (a != 32) & ((a - np.uint8(9)) > 4)
        step = np.diff(inside)
        begin, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if edges and len(begin):
            begin, stop = _stripped(data[at:end], a, begin, stop, edges)
        power, inverse = _power_table(len(a))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTES[a] * power[: len(a)], out=sums[1:])
        hashes.append(mix((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64) * _P3))
        places.append(begin + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def hashed_words(texts: list[bytes], edges: bytes = b"") -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    if not texts:
        return []
    h, at = word_hashes(b"\n".join(texts), edges)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return np.split(h, np.searchsorted(at, begin[1:]))


def lowered(text: str) -> bytes:
    """UTF-8, with A-Z as a-z."""
    return text.encode("utf-8", "surrogatepass").lower()


def words_of(text: str) -> list[bytes]:
    """Words are runs of bytes other than ASCII white space; A-Z count as a-z."""
    return lowered(text).split()


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes, in ascending order, of the k-word shingles; of fewer words, the whole sequence is one."""
    n = len(h)
    if n == 0:
        return h
    with np.errstate(over="ignore"):
        w = min(k, n)
        out = np.full(n - w + 1, _MASK(w), np.uint64)
        for i in range(w):
            out = (out + h[i : n - w + 1 + i]) * _P3
            out ^= out >> _MASK(29)
        out = np.sort(mix(out))
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


#: Tables that one task of ``tree_sum`` adds up.
FAN = 16


def tree_sum(rows: DataFrame, dtype: str, size: int) -> np.ndarray:
    """The sum of equally long arrays (a binary column ``table``, about one a task); only the sum comes to the driver.

    The tree is as deep as the number of tasks asks for: no task adds more than about FAN tables.
    """

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for x in batch.column(0):
                x = np.frombuffer(x.as_buffer(), dtype)
                total = x.copy() if total is None else np.add(total, x, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["table"])

    n = rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        rows = rows.repartition(n).mapInArrow(tidied(run), "table binary")
    got = rows.collect()
    return np.sum([np.frombuffer(x.table, dtype) for x in got], axis=0, dtype=dtype) if got else np.zeros(size, dtype)


# -- sets of keys, pairs, components --------------------------------------------------------


def with_ids(docs: DataFrame, needed: DataFrame, most: int | None = None) -> DataFrame:
    """``docs`` joined to the rows of ``needed`` on doc_id (nulls match); broadcast behind a check of the size."""
    most = BROADCAST_ROWS if most is None else most
    right = needed.withColumnRenamed("doc_id", "__id")
    if needed.limit(most + 1).count() <= most:
        right = F.broadcast(right)
    return docs.join(right, docs["doc_id"].eqNullSafe(F.col("__id"))).drop("__id")


def similar(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) of ids whose full sets satisfy 100 * intersection >= share * union.

    ``sets`` has (id, items): 8-byte values in ascending order.  Both joins are plain equi-joins,
    of which Spark splits the skewed partitions.
    """
    sets = sets.groupBy("id").agg(F.first("items").alias("items"))
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(u), len(v)) < share * max(len(u), len(v)):
                    keep.append(False)
                    continue
                common = np.intersect1d(u, v, assume_unique=True).size
                keep.append(100 * common >= share * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(tidied(verify), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each connected component, by alternating large and small stars.

    Each round is an aggregate with a map-side part and an equi-join, and is written to the shared
    folder.  Only a count and a checksum of the links come to the driver.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s")).select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u <> v")
        e = materialize(small.distinct(), "edges")
        now = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
        seen = now
    raise RuntimeError("the components have not settled")
