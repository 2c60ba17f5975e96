"""Near-duplicate lines by an exact set-similarity join over words.

A line's tokens are its distinct words.  Lines with the same tokens are one class.  Tokens are ordered by rarity, counted over
all lines in a table of fixed size (any order gives the same result; a good one keeps common words out of the prefixes).
Two classes whose Jaccard similarity reaches the threshold share a token of their prefixes; the shorter one's prefix may even
end sooner.  Sizes, positions and a bitmap filter exclude most others: the parities of a set's hashed tokens differ in at
most as many bits as the sets differ in tokens.  Full sets decide.  A line goes if an earlier line (by doc_id, then place)
matches it.

Lines and prefix entries travel as packed arrays, dealt out by token.  A token that so many lines hold that its entries could
be a large part of a task goes another way: its entries are counted, each first meets the earliest class of its
token, and what this leaves open is compared in pairs of blocks.  Only pairs that pass all filters become rows, and of these
the NEAREST of each class first: every line needs one earlier match only.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import common

#: Cells of the table of counts (a power of two).
CELLS = 1 << 20
#: Earlier classes of a class that are verified first, the most alike ones: so many if the bitmaps say that one is well within the limit, else more.
NEAREST, UNSURE = 4, 128
#: Entries of a token that surely meet in one task, and the part of a task's usual share that they may be at larger sizes.
TOGETHER, PART = 20_000, 16
#: Entries of a block of a larger token.
BLOCK_ROWS = 8192
#: Prefix entries that a task packs at once, and pairs that are compared at once.
PACKED, PAIRS = 200_000, 1 << 19
NO_ID = -(2**63)
#: Sizes and places from here on are all stored as this one, and filters then let everything pass.
BEYOND = 65535
ENTRY = np.dtype([("token", "<u8"), ("half", "<u8"), ("low", "<u8"), ("high", "<u8"), ("did", "<i8"), ("line", "<u4"), ("n", "<u2"), ("pos", "<u2")])
LINE = np.dtype([("did", "<i8"), ("dk", "<i8"), ("line", "<i4"), ("n", "<i4"), ("cls", "V16")])
#: What the tasks give: lines (kind 0: x is dk, y half), pairs (1: x later than y), entries of large tokens (2: x token, y half), entries of classes
#: of which more pairs passed (3: x token, y half).
FOUND = "kind int, did long, line int, n int, pos int, x long, y long, low long, high long, cls binary"


def words_of_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of all lines that are not blank, how many words each line has, its text's number and its place."""
    raw = [common.lowered(t) for t in texts]
    joined = b"\n".join(raw)
    h, at = common.word_hashes(joined)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 10), at)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    line, sizes = line[first], np.diff(np.append(first, len(h)))
    begin = np.cumsum([0] + [t.count(b"\n") + 1 for t in raw[:-1]])
    text = np.searchsorted(begin, line, "right") - 1
    return h, sizes, text, line - begin[text]


def cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """(did, dk, text): rows that repeat a doc_id and its text are one document."""
    rows = common.texts(docs)
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("dk"), "text")


def rarity(docs: DataFrame) -> np.ndarray:
    """How often words of each cell occur in all lines."""

    def run(batches):
        import pyarrow as pa

        total, held, size = np.zeros(CELLS, np.float32), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                held.append(cell(common.word_hashes(b"\n".join(common.lowered(t) for t in batch.slice(at, 100).column(0).to_pylist()))[0]).astype(np.int32))
                size += len(held[-1])
                if size > 2 * CELLS:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["table"])

    return common.tree_sum(common.texts(docs).select("text").mapInArrow(common.tidied(run), "table binary"), "<f4", CELLS)


def overlap(both, share: int):
    """The least overlap of sets with ``both`` items together: ceil(share * both / (100 + share))."""
    return -(-share * both // (100 + share))


def candidates(e: np.ndarray, share: int, group: np.ndarray | None = None, side: np.ndarray | None = None, open_: np.ndarray | None = None):
    """Yields (later, earlier, distance, whether that is well within the limit) of entries of one token that sizes, places and bitmaps allow, as places in ``e``.

    ``group`` tells which entries meet (else the token); ``side`` excludes pairs of one side; ``open_`` tells whose earlier matches are sought.
    """
    group = e["token"] if group is None else group
    order = np.lexsort((e["n"], group))
    n, pos, g = e["n"][order].astype(np.int64), e["pos"][order].astype(np.int64), group[order]
    number = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    key = (number << 17) + n
    most = np.where(n >= BEYOND, BEYOND, np.minimum(BEYOND, 100 * n // share))
    start = np.arange(1, len(e) + 1)
    stop = np.searchsorted(key, (number << 17) + most, "right")
    # the smaller set of a pair needs 2 * share / (100 + share) of its items
    stop = np.where((n < BEYOND) & (pos >= n - overlap(2 * n, share) + 1), start, np.maximum(start, stop))
    ends, at = np.cumsum(stop - start), 0
    low, high, did, line = e["low"][order], e["high"][order], e["did"][order], e["line"][order]
    while at < len(e):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        many = (stop - start)[at:to]
        u = np.repeat(np.arange(at, to), many)
        v = np.arange(len(u)) - np.repeat(np.cumsum(many) - many, many) + start[u]
        at = to
        both = n[u] + n[v]
        need = overlap(both, share)
        sure = n[v] < BEYOND
        # this token is the first that both have, or another one finds the pair
        ok = (np.minimum(n[u] - pos[u], n[v] - pos[v]) >= need) | ~sure
        u, v, both, need, sure = u[ok], v[ok], both[ok], need[ok], sure[ok]
        apart = np.bitwise_count(low[u] ^ low[v]).astype(np.int64) + np.bitwise_count(high[u] ^ high[v])
        ok = (apart <= both - 2 * need) | ~sure
        if side is not None:
            ok &= side[order[u]] != side[order[v]]
        well = 2 * apart <= both - 2 * need
        u, v, apart, well = u[ok], v[ok], apart[ok], well[ok]
        after = (did[u] > did[v]) | ((did[u] == did[v]) & (line[u] > line[v]))
        tied = (did[u] == did[v]) & (line[u] == line[v])  # texts of one doc_id; the full order decides later
        a = np.concatenate([np.where(after, u, v), np.where(after, v, u)[tied]])
        b = np.concatenate([np.where(after, v, u), np.where(after, u, v)[tied]])
        apart, well = np.concatenate([apart, apart[tied]]), np.concatenate([well, well[tied]])
        a, b = order[a], order[b]
        if open_ is not None:
            ok = open_[a]
            a, b, apart, well = a[ok], b[ok], apart[ok], well[ok]
        if len(a):
            yield a, b, apart, well


def earliest(e: np.ndarray) -> np.ndarray:
    """One entry of each token and class, the earliest."""
    e = e[np.lexsort((e["line"], e["did"], e["half"], e["token"]))]
    return e[np.concatenate([[True], (e["token"][1:] != e["token"][:-1]) | (e["half"][1:] != e["half"][:-1])])] if len(e) else e


def classes_of(found, e: np.ndarray):
    """The candidates with their classes in place of their places in ``e``."""
    half = e["half"].copy().view(np.int64)
    for a, b, apart, well in found:
        yield half[a], half[b], apart.astype(np.uint8), well  # a bitmap has 128 bits


def nearest(found, whole: bool):
    """(later classes, earlier classes, those later ones that have more) of candidates, given by classes; of each class the nearest ones, or all."""
    found = list(found)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, apart, well = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, apart, ~well, a))
    a, b, well = a[order], b[order], well[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) & (a != b)
    a, b, well = a[fresh], b[fresh], well[fresh]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(a)))
    most = sizes if whole else np.where(well[first], NEAREST, UNSURE)
    keep = np.arange(len(a)) - np.repeat(first, sizes) < np.repeat(most, sizes)
    return a[keep], b[keep], a[first][sizes > most]


def met(parts: dict[int, list[np.ndarray]], share: int, only: np.ndarray | None = None):
    """(later classes, earlier classes, tokens and classes of entries whose class has more) of entries by part; empties ``parts``.

    All entries of a token are in one part, so the parts are sorted and compared one after another; the nearest are taken over all of them.
    With ``only``, all pairs whose later class is one of these.
    """
    found, held = [], []
    for part in sorted(parts):
        e = earliest(np.concatenate(parts.pop(part)))
        half = e["half"].copy().view(np.int64)
        found += classes_of(candidates(e, share, open_=None if only is None else np.isin(half, only)), e)
        held.append((e["token"].copy(), half))
    a, b, more = nearest(found, only is not None)
    keep = [np.isin(half, more) for _, half in held]
    none = [np.zeros(0, np.int64)]
    tokens = np.concatenate([*none, *[t[k].view(np.int64) for (t, _), k in zip(held, keep)]])
    return a, b, tokens, np.concatenate([*none, *[h[k] for (_, h), k in zip(held, keep)]])


def planes(x: np.ndarray) -> bytes:
    """The records' first bytes, then their second ones, and so on: most are zero or alike, which Spark's compression then finds."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def records(raw, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def halves(cls: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each class."""
    return np.frombuffer(cls.tobytes(), "<i8")[::2].copy()


def _rows(kind: int, size: int, **columns):
    import pyarrow as pa

    schema = [f.split(" ") for f in FOUND.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns["kind"] = np.full(size, kind)
    cast = {"int": np.int32, "long": np.int64}
    made = lambda x, t: pa.array(np.ascontiguousarray(x).astype(cast[t], copy=False)) if t in cast else x
    return pa.RecordBatch.from_arrays([made(columns[c], t) if c in columns else pa.nulls(size, kinds[t]) for c, t in schema], [c for c, _ in schema])


def found_lines(docs: DataFrame, share: int, counts: np.ndarray, only: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Lines, pairs and entries, as FOUND says.  ``only`` has classes and tokens: all pairs whose later class is one of these, and nothing else."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    together = max(TOGETHER, float(counts.sum()) * (100 - share) / 100 / parts / PART)
    held = spark.sparkContext.broadcast((counts, only))  # CELLS numbers, and classes and tokens of checked numbers
    keys = 4 * parts

    def pack(batches):
        import pyarrow as pa

        counts, only = held.value
        steps = np.minimum(127, 4 * np.log2(1 + counts)).astype(np.uint64)  # in steps of a fourth of a doubling
        large = counts > together
        seen: dict[bytes, list[int]] = {}  # the earliest place of a class so far
        lines, entries, size = [], [], 0

        def flush():
            l, e = np.concatenate(lines), np.concatenate(entries)
            lines.clear(), entries.clear()
            deal_l = np.arange(len(l)) % keys
            big = large[cell(e["token"])]
            deal_e = (common.mix(np.where(big, e["half"], e["token"])) % np.uint64(keys)).astype(np.int64)
            l, e = l[np.argsort(deal_l, kind="stable")], e[np.argsort(deal_e, kind="stable")]
            cut_l, cut_e = np.cumsum(np.bincount(deal_l, minlength=keys)), np.cumsum(np.bincount(deal_e, minlength=keys))
            some = np.flatnonzero(np.diff(cut_l, prepend=0) + np.diff(cut_e, prepend=0))
            to = lambda x, cut, i: planes(x[cut[i - 1] if i else 0 : cut[i]])
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([to(l, cut_l, i) for i in some], pa.binary()), pa.array([to(e, cut_e, i) for i in some], pa.binary())], ["part", "lines", "entries"])

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                h, sizes, doc, places = words_of_lines(part.column(2).to_pylist())
                if not len(places):
                    continue
                own = np.repeat(np.arange(len(sizes)), sizes)
                often = steps[cell(h)]
                # line, then rarity, then the token itself
                packed = (own.astype(np.uint64) << np.uint64(48)) | (often << np.uint64(41)) | (h >> np.uint64(23))
                order = np.argsort(packed)
                packed = packed[order]
                if len(places) >= 2**16 or ((packed[1:] == packed[:-1]) & (h[order][1:] != h[order][:-1])).any():
                    order = np.lexsort((h, often, own))
                t, own = h[order], own[order]
                fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (t[1:] != t[:-1])])
                t, own = t[fresh], own[fresh]
                n = np.bincount(own, minlength=len(places))
                ends = np.cumsum(n)
                raw, cls, new, did = t.tobytes(), [], np.zeros(len(places), bool), part.column(0).to_numpy()[doc]
                for i, (a, b, *own_place) in enumerate(zip((8 * (ends - n)).tolist(), (8 * ends).tolist(), did.tolist(), places.tolist())):
                    cls.append(c := xxhash.xxh3_128_digest(raw[a:b]))
                    if (before := seen.get(c)) is None or own_place < before:
                        new[i] = True
                        if len(seen) >= 60_000:
                            seen.clear()
                        seen[c] = own_place
                cls = np.frombuffer(b"".join(cls), "V16")
                rows = np.empty(len(places), LINE)
                rows["did"], rows["dk"], rows["line"], rows["n"], rows["cls"] = did, part.column(1).to_numpy()[doc], places, n, cls
                lines.append(rows if only is None else rows[:0])
                p = np.where(new & (n > 3), n - (-(-share * n // 100)) + 1, 0)  # smaller sets match equal ones only
                place = np.arange(len(t)) - np.repeat(ends - n, n)
                bit = common.mix(t) >> np.uint64(57)
                one = np.uint64(1) << (bit & np.uint64(63))
                bits = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, one, np.uint64(0)), ends - n) for k in (np.uint64(0), np.uint64(1))]
                keep = place < p[own]
                if only is not None:
                    keep &= np.isin(t, only[1])
                of = own[keep]
                e = np.empty(len(of), ENTRY)
                e["token"], e["half"], e["low"], e["high"] = t[keep], halves(cls)[of].view(np.uint64), bits[0][of], bits[1][of]
                e["did"], e["line"], e["n"], e["pos"] = rows["did"][of], places[of], np.minimum(n, BEYOND)[of], np.minimum(place, BEYOND)[keep]
                entries.append(e)
                size += len(e) + len(lines[-1])
                if size >= PACKED:
                    yield flush()
                    size = 0
        if lines:
            yield flush()

    def compare(batches):
        import pyarrow as pa

        counts, only = held.value
        large, parts = counts > together, {}
        for batch in batches:
            for part, lines, entries in zip(*batch.columns):  # one row at a time is copied out of the batch
                if len(x := records(lines.as_buffer(), LINE)):
                    cls = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(x["cls"].tobytes())]).cast(pa.binary())
                    yield _rows(0, len(x), did=x["did"], line=x["line"], n=x["n"], x=x["dk"], y=halves(x["cls"]), cls=cls)
                e = records(entries.as_buffer(), ENTRY)
                big = large[cell(e["token"])]
                if big.any() and only is None:
                    x = e[big]
                    yield _rows(2, len(x), did=x["did"], line=x["line"], n=x["n"], pos=x["pos"], x=x["token"], y=x["half"], low=x["low"], high=x["high"])
                parts.setdefault(part.as_py(), []).append(e[~big] if big.any() else e)
        a, b, tokens, more = met(parts, share, None if only is None else only[0])
        yield _rows(1, len(a), x=a, y=b)
        yield _rows(3, len(more), x=tokens, y=more)

    packed = _keyed(docs).mapInArrow(common.tidied(pack), "part int, lines binary, entries binary")
    return packed.repartition(parts, "part").mapInArrow(common.tidied(compare), FOUND)


def line_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(id, items) of the lines in ``needed`` (id, did, dk, line)."""
    wanted = needed.groupBy("did", "dk").agg(F.collect_list(F.struct("line", "id")).alias("lines"))
    right = wanted.withColumnsRenamed({"did": "d1", "dk": "d2"})
    if needed.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        right = F.broadcast(right)
    keyed = _keyed(docs)
    rows = keyed.join(right, (keyed["did"] == F.col("d1")) & (keyed["dk"] == F.col("d2"))).select("text", "lines")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part, ids, held = batch.slice(at, 50), [], []
                for text, lines in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = common.lowered(text).split(b"\n")
                    for x in lines:
                        ids.append(x["id"])
                        held.append(own[x["line"]])
                items = [np.unique(h).tobytes() for h in common.hashed_words(held)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], ["id", "items"])

    return rows.mapInArrow(common.tidied(run), "id long, items binary")


def compared(dealt: DataFrame, share: int) -> DataFrame:
    """Pairs (a later than b) of rows of one (token, i, j) that the filters allow, a open; rows of one block meet if i is j.

    ``dealt`` has token, i, j, own and the columns of an entry; a group holds about two blocks.
    """
    names = ["token", "i", "j", "own", "half", "did", "line", "n", "pos", "low", "high", "open"]

    def run(batches):
        import pyarrow as pa

        def out(c):
            e = np.empty(len(c["token"]), ENTRY)
            for k in ("half", "low", "high", "token"):
                e[k] = c[k].view(np.uint64)
            for k in ("did", "line", "n", "pos"):
                e[k] = c[k]
            change = np.concatenate([[False], (np.diff(c["token"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)])
            same = c["i"] == c["j"]  # one block: every entry is a side of its own
            side = np.where(same, np.arange(len(e)), -1 - c["own"])
            a, b, _ = nearest(classes_of(candidates(e, share, np.cumsum(change), side, c["open"].astype(bool)), e), True)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in names}
            if held:
                c = {x: np.concatenate([held[x], c[x]]) for x in c}
            whole = np.flatnonzero((c["token"] != c["token"][-1]) | (c["i"] != c["i"][-1]) | (c["j"] != c["j"][-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut >= PACKED // 8:  # a batch may end within a group
                yield out({x: y[:cut] for x, y in c.items()})
                c = {x: y[cut:] for x, y in c.items()}
            held = c
        if held and len(held["token"]):
            yield out(held)

    return dealt.select(names).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(common.tidied(run), "a long, b long")


def marked_lines(docs: DataFrame, share: int = 80) -> DataFrame:
    """(did, dk, line, removed) of each line that is not blank; see the module.

    did is the doc_id (a missing one is -2^63 and comes first), dk a hash of the text, line the place from 0.  Blank
    lines are in no answer.  Null and empty texts have none; an empty table gives no rows.  Lines that repeat or tie with an
    earlier one go; rows that repeat a doc_id and its text are one document.  Very long texts and lines are taken whole.
    """
    counts = rarity(docs)
    found = common.materialize(found_lines(docs, share, counts), "lines")
    lines = found.where("kind = 0").select("did", F.col("x").alias("dk"), "line", "cls", F.col("y").alias("half"))
    classes = common.materialize(lines.groupBy("cls").agg(F.min(F.struct("did", "dk", "line")).alias("first"), F.min("half").alias("half")), "line-classes")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """(id) of classes that an earlier class matches."""
        pairs = common.materialize(pairs.select("a", "b").distinct(), "line-pairs")
        ids = pairs.select(F.col("a").alias("half")).union(pairs.select("b")).distinct()
        needed = common.materialize(classes.join(ids, "half", "left_semi").select(F.col("half").alias("id"), "first.did", "first.dk", "first.line"), "needed")
        linked = common.similar(pairs, line_sets(docs, needed), share)
        place = lambda x: needed.select(F.col("id").alias(x), F.struct("did", "dk", "line").alias("first" + x))
        tied = linked.join(place("a"), "a").join(place("b"), "b")
        return common.materialize(tied.where("firstb < firsta").select(F.col("a").alias("id")).distinct(), "gone")

    near = found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))
    large = found.where("kind = 2").select(F.col("x").alias("token"), F.col("y").alias("half"), "did", "line", "n", "pos", "low", "high")
    large = common.materialize(large.groupBy("token", "half").agg(F.min(F.struct("did", "line", "n", "pos", "low", "high")).alias("e")).select("token", "half", "e.*"), "large")
    head = large.groupBy("token").agg(F.min(F.struct("did", "line", "half", "n", "pos", "low", "high")).alias("h"), F.count("*").alias("size"))
    head = common.materialize(head.where("size > 1").select("token", "size", *[F.col(f"h.{c}").alias("h_" + c) for c in ("half", "n", "pos", "low", "high")]), "heads")
    least = F.expr(f"cast(ceil({share} * (n + h_n) / {100 + share}) as int)")
    apart = F.expr("bit_count(low ^ h_low) + bit_count(high ^ h_high)")
    sure = F.greatest("n", "h_n") < BEYOND
    can = ((F.least(F.col("n") - F.col("pos"), F.col("h_n") - F.col("h_pos")) >= least) & (apart <= F.col("n") + F.col("h_n") - 2 * least)) | ~sure
    with_head = large.join(head, "token").where("half <> h_half")
    gone = confirmed(near.union(with_head.where(can).select(F.col("half").alias("a"), F.col("h_half").alias("b"))))
    # what is still open and has not met all
    blocks = with_head.join(gone, F.col("half") == F.col("id"), "left").withColumn("open", F.col("id").isNull()).withColumn("blocks", F.ceil(F.col("size") / BLOCK_ROWS)).withColumn("own", F.expr("pmod(xxhash64(half), blocks)"))
    dealt = blocks.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    more = compared(dealt, share)
    left = found.where("kind = 3").select(F.col("y").alias("id"), F.col("x").alias("token")).join(gone, "id", "left_anti")
    left = common.materialize(left, "open")
    turns = -(-left.count() // common.BROADCAST_ROWS)
    for turn in range(turns):  # one, but for very many: their classes and tokens go to every executor
        rows = left.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn).toArrow()
        rest = found_lines(docs, share, counts, (np.unique(rows["id"].to_numpy()), np.unique(rows["token"].to_numpy().view(np.uint64)))).where("kind = 1")
        more = more.union(rest.select(F.col("x").alias("a"), F.col("y").alias("b")))
    gone = gone.union(confirmed(more)).distinct()
    verdict = classes.join(gone.withColumn("out", F.lit(True)), F.col("half") == F.col("id"), "left").select("cls", "first", F.coalesce("out", F.lit(False)).alias("out"))
    marked = lines.select("did", "dk", "line", "cls").distinct().join(verdict, "cls")
    return marked.select("did", "dk", "line", (F.col("out") | (F.struct("did", "dk", "line") != F.col("first"))).alias("removed"))


def removals(docs: DataFrame, share: int = 80) -> DataFrame:
    """(did, dk, n_lines, removed): per document that has lines, how many, and the places of those that go, ascending."""
    marked = marked_lines(docs, share)
    return marked.groupBy("did", "dk").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line")))).alias("removed"))


def without(text: Column, removed: Column) -> Column:
    """The text without the lines at the given places."""
    held = F.struct(F.split(text, "\n", -1).alias("lines"), removed.alias("gone"))
    kept = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"]), lambda i: F.get(x["lines"], i))
    return F.element_at(F.transform(F.array(held), lambda x: F.array_join(kept(x), "\n")), 1)


def dedup_lines(docs: DataFrame, share: int = 80) -> DataFrame:
    """``docs`` with the texts rewritten (and n_chars, if there is one); all other columns stay.

    A document that has lost all lines goes; one that had none (a null, empty or blank text) stays as it is.  Rows that repeat
    a doc_id and text are treated alike; rows without a doc_id come before all others.  An empty table gives no rows.
    """
    did, dk, n, places = (common.free(docs, c) for c in ("__did", "__dk", "__n", "__gone"))
    gone = removals(docs, share).where("size(removed) > 0").withColumnsRenamed({"did": did, "dk": dk, "n_lines": n, "removed": places})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.join(gone, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col(did)) & (F.xxhash64(text) == F.col(dk)), "left")
    same = F.col(n).isNull()
    out = out.where(same | (F.size(places) < F.col(n))).withColumn("text", F.when(same, F.col("text")).otherwise(without(text, F.col(places))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines that are not blank, n_removed, and the places of the removed lines, joined by commas.

    A null, empty or blank text has no lines; rows that repeat a doc_id and text each give the same row; an empty table gives none.
    """
    docs = common.table(spark, sf_dir, "documents")
    keys = _keyed(docs).select("did", "dk")
    out = keys.join(removals(docs), ["did", "dk"], "left")
    doc_id = F.when(F.col("did") != NO_ID, F.col("did"))
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(doc_id.alias("doc_id"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), F.array_join(gone, ",").alias("removed"))


#: The same rows by a join of prefixes and a count of what candidates share; for small tables whose doc_ids are distinct.
OP8_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS held FROM documents),
single AS (SELECT doc_id, unnest(range(len(held))) AS line, unnest(held) AS l FROM split),
lines AS (
  SELECT doc_id, line, doc_id::HUGEINT * 4294967296 + line AS place,
    list_sort(list_distinct(list_filter(string_split_regex(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w
  FROM single
), classes AS (SELECT w, len(w) AS n, min(place) AS first, row_number() OVER () AS id FROM lines WHERE len(w) > 0 GROUP BY w),
words AS (SELECT id, n, first, unnest(w) AS word FROM classes),
often AS (SELECT word, count(*) AS f FROM words GROUP BY word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f, word) AS r FROM words JOIN often USING (word)),
prefix AS (SELECT * FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b ON a.word = b.word AND a.first > b.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
shared AS (SELECT x, y, any_value(p.n + q.n) AS total, count(*) AS c FROM pairs JOIN words p ON p.id = x JOIN words q ON q.id = y AND q.word = p.word GROUP BY x, y),
gone AS (SELECT DISTINCT x AS id FROM shared WHERE 100 * c >= 80 * (total - c)),
marked AS (SELECT doc_id, line, place > first OR id IN (SELECT id FROM gone) AS out FROM lines JOIN classes USING (w))
SELECT doc_id, count(line) AS n_lines, count(line) FILTER (WHERE out) AS n_removed, coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (WHERE out), '') AS removed
FROM documents LEFT JOIN marked USING (doc_id) GROUP BY doc_id
"""
