"""Token ids in binary shards with a minimal perfect hash index for keyed access.

A shard file holds the documents of one range of doc_ids: ``SLUICE1\\n``, the length of a JSON header (8 bytes,
little-endian), the header, then the sections that the header places (all little-endian):

- payload: the raw ids, one document after the other, 2 or 4 bytes each (``width``);
- keys: distinct doc_ids in ascending order (int64; a missing doc_id is the header's ``null_key``);
- sizes: ids of each record in order (uint32);
- levels: the bits of the minimal perfect hash, level by level (each key is at the first level at which no other
  remaining key shares its bit; its slot is the number of bits set before it);
- prints: by slot, a 32-bit fingerprint of the key;
- first, records, offset: by slot, the key's first record, how many it has, and where its ids begin in the shard.

A lookup hashes the key, counts bits, compares the fingerprint, and seeks: its cost does not grow with the shard.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm import common

MAGIC = b"SLUICE1\n"
NULL_KEY = -(2**63)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (common.mix(keys.view(np.uint64) + np.uint64(level + 1) * common._P3) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (common.mix(common.mix(keys.view(np.uint64)) * common._P2) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: a cascade of bit arrays."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.concatenate([[0], np.cumsum(x)[:-1]]) if len(x) else np.zeros(0, np.int64) for x in levels]
        self.base = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.6) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(8, int(gamma * len(left)))
            at = _slots(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys must be distinct")
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any value or -1 for keys that were not there."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = _slots(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.base[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        return out


def _open(path: str):
    from pyarrow import fs

    path = re.sub("^s3[an]:", "s3:", path)  # Hadoop's names for it
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else "file://" + path)


class ShardWriter:
    """Streams documents in key order to a file that appears under its name when it is whole."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = _open(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.width, self.keys, self.sizes, self.bytes = width, [], [], 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(NULL_KEY if key is None else key)
        self.sizes.append(len(ids) // self.width)
        self.bytes += len(ids)
        self.out.write(ids)

    def close(self) -> tuple[int, int]:
        """Writes the index after the payload, the place of the index at the end; returns documents and ids."""
        keys, sizes = np.array(self.keys, "<i8"), np.array(self.sizes, "<u4")
        distinct, first, records = np.unique(keys, return_index=True, return_counts=True)
        before = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]).astype("<u8")
        hash_ = PerfectHash.build(distinct)
        slot = hash_(distinct)
        by_slot = {n: np.zeros(len(distinct), k) for n, k in (("prints", "<u4"), ("first", "<u8"), ("records", "<u4"), ("offset", "<u8"))}
        by_slot["prints"][slot], by_slot["first"][slot], by_slot["records"][slot], by_slot["offset"][slot] = fingerprints(distinct), first, records, before[first]
        sections = {"keys": distinct, "sizes": sizes, **by_slot, **{f"level{i}": np.packbits(x) for i, x in enumerate(hash_.levels)}}
        head = {"width": self.width, "null_key": NULL_KEY, "ids": int(before[-1]), "levels": [len(x) for x in hash_.levels], "sections": {}}
        at = int(before[-1]) * self.width
        for name, x in sections.items():
            head["sections"][name] = [at, x.nbytes, x.dtype.str]
            self.out.write(x.tobytes())
            at += x.nbytes
        text = json.dumps(head).encode()
        self.out.write(text + len(text).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return len(keys), int(before[-1])


class ShardReader:
    """Reads the index once and then any key's ids by one seek."""

    def __init__(self, path: str):
        f, p = _open(path)
        self.file = f.open_input_file(p)
        end = self.file.size()
        tail = self.file.read_at(16, end - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no shard file")
        n = int.from_bytes(tail[:8], "little")
        self.head = head = json.loads(self.file.read_at(n, end - 16 - n))
        part = {k: np.frombuffer(self.file.read_at(size, at), kind) for k, (at, size, kind) in head["sections"].items()}
        self.keys, self.sizes, self.part, self.width = part["keys"], part["sizes"], part, head["width"]
        self.before = np.concatenate([[0], np.cumsum(self.sizes.astype(np.int64))])
        self.hash = PerfectHash([np.unpackbits(part[f"level{i}"], count=c).astype(bool) for i, c in enumerate(head["levels"])])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the fingerprint differs."""
        slot = self.hash(keys)
        ok = slot >= 0
        ok[ok] = self.part["prints"][slot[ok]] == fingerprints(keys[ok])
        return np.where(ok, slot, -1)

    def record(self, i: int) -> np.ndarray:
        raw = self.file.read_at(int(self.sizes[i]) * self.width, int(self.before[i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each record of the key; none if it is not there."""
        slot = int(self.find(np.array([NULL_KEY if key is None else key], np.int64))[0])
        if slot < 0:
            return []
        first, at = int(self.part["first"][slot]), int(self.part["offset"][slot])
        out = []
        for i in range(first, first + int(self.part["records"][slot])):
            out.append(np.frombuffer(self.file.read_at(int(self.sizes[i]) * self.width, at * self.width), f"<u{self.width}"))
            at += int(self.sizes[i])
        return out


#: A shard file ends after so many bytes of ids or so many documents; a task writes as many files as it needs.
SHARD_BYTES, SHARD_DOCS = 256 << 20, 1_000_000
#: Stored bytes of input for one task, if that makes more tasks than the shuffle's setting.
TASK_BYTES = 256 << 20
#: Texts within these code points, which no normal form changes, may be lower-cased at once.
_OTHER = re.compile("[^\x00-\u024f]|\u0130")
KNOWN_WORDS = 1_200_000


def word_encoder(path: str, end_id: int, width: int):
    """A function from texts to raw ids; words are encoded once and remembered, up to KNOWN_WORDS.

    The tokenizer's normaliser and pattern drop white space and never join across it, so a text's ids are those of its
    words between spaces, tabs and line ends; it lower-cases; and it parts letters from one full stop or comma.
    What is known stays with the Python process, which serves many tasks.
    """
    import os
    import sys
    import types
    from array import array

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    kept = sys.modules.setdefault("_sluice_words", types.ModuleType("_sluice_words")).__dict__  # functions travel by value, modules stay
    if (path, width) not in kept:
        kept[path, width] = (tokenizers.Tokenizer.from_file(path), {})
    one, known = kept[path, width]
    kind = {2: "H", 4: "I"}[width]
    tail = np.array([end_id], f"<u{width}").tobytes()

    def learn(words: list[str]) -> None:
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            for w, e in zip(part, one.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = array(kind, e.ids).tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > KNOWN_WORDS:
            known.clear()
        # special tokens are found before letters are lower-cased
        plain = [t if "<|" in t or _OTHER.search(t) else t.lower() for t in texts]
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in plain]
        new = set().union(*split).difference(known)
        ended = [w for w in new if w[-1:] in (".", ",") and w[:-1].isalpha() and not _OTHER.search(w)]
        learn(list({w[:-1] for w in ended}.union(new.difference(ended), ".,").difference(known)))
        for w in ended:
            known[w] = known[w[:-1]] + known[w[-1]]
        return [b"".join(map(known.__getitem__, ws)) + tail for ws in split]

    return encode


def write(docs: DataFrame, path: str, end_id: int = 1, max_id: int = 49407, folder: str | None = None) -> DataFrame:
    """Writes the ids of all documents as shard files in ascending doc_id order; returns the manifest.

    The manifest has a row per shard: part and nth (ascending with the doc_ids), path, n_docs, n_ids, start (ids of all shards
    before).  Rows without a doc_id come first; rows that repeat one stand together, if need be in several files.  A null or empty
    text has only the end id; a very long one is written whole; an empty table gives no files.  A file that a lost
    task left is in no manifest.  Two bytes an id are written where all ids fit.
    """
    spark = docs.sparkSession
    folder = folder or common.new_path(spark, "shards")
    width = 2 if max(end_id, max_id) < 2**16 else 4
    stored = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # the plan knows the sizes of files; of other tables it may only know a very large bound
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored // TASK_BYTES if stored < 1 << 50 else 1)
    place = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), "row"]  # also rows that repeat very often are dealt to several tasks
    rows = common.texts(docs).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tasks, *place).sortWithinPartitions(*place).select("doc_id", "text")

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        writer, encode, name, nth = None, word_encoder(path, end_id, width), "", 0

        def done():
            n, ids = writer.close()
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([nth], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([ids], pa.int64())], ["part", "nth", "path", "n_docs", "n_ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    if writer is None:
                        name = f"{folder}/shard-{uuid.uuid4().hex}.ids"
                        writer = ShardWriter(name, width)
                    writer.add(key, ids)
                    if writer.bytes >= SHARD_BYTES or len(writer.keys) >= SHARD_DOCS:
                        yield done()
                        writer, nth = None, nth + 1
        if writer is not None:
            yield done()

    shards = common.materialize(rows.mapInArrow(common.tidied(run), "part int, nth int, path string, n_docs long, n_ids long"), "manifest")
    before = W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)  # a row per shard
    return common.materialize(shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, each found through its shard's index."""

    def run(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(path)
                for at in range(0, len(shard.keys), 2000):
                    keys = shard.keys[at : at + 2000]
                    slots = shard.find(keys)
                    if (slots < 0).any():
                        raise ValueError(f"{path}: a key is missing in the index")
                    out = []
                    for key, slot in zip(keys.tolist(), slots.tolist()):
                        first, pos = int(shard.part["first"][slot]), int(shard.part["offset"][slot])
                        for i in range(first, first + int(shard.part["records"][slot])):
                            ids = shard.record(i)
                            out.append((None if key == NULL_KEY else key, start + pos, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            pos += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("path", "start").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return shards.mapInArrow(common.tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    """Writes all documents and reads the files back; nulls, repeated rows and empty tables as in ``write``."""
    import public_tokenizers

    return read(write(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
