"""Operators against brute force on small tables with nulls, empty and long texts, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import bpe, common, decontaminate, line_dedup, near_dedup, quality, registry, secrets, sharding, token_store, topk, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score double, component_id string, ids int, slot int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x", 1, 2) for i, t in rows], SCHEMA)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def linked(a, b, share):
    return bool(a and b) and 100 * len(a & b) >= share * len(a | b)


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(30, 150))) for _ in range(25)]
    rows = list(enumerate(base))
    for i in range(60):  # near and exact copies
        w = r.choice(base).split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((100 + i, " ".join(w)))
    long_ = "\n".join(" ".join(r.choice(vocabulary) for _ in range(30)) for _ in range(900))
    return [*rows, (300, None), (301, ""), (302, " \n\t"), (303, "One"), (304, "one"), (305, "a B"), (306, "x" * 30000), (307, long_), (308, long_), (None, base[0]), (None, None), (3, base[3]), (3, base[3])]


@pytest.mark.parametrize("shingle,share", [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd_rows, shingle, share):
    sets = [shingle_set(t, shingle) for _, t in odd_rows]
    part = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j], share):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    low = {}
    for (d, _), p in zip(odd_rows, part):
        low[p] = min((x for x in (low.get(p), d) if x is not None), default=None)
    want = sorted(((d, len(s), low[p], d == low[p]) for (d, _), s, p in zip(odd_rows, sets, part)), key=repr)
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(frame(spark, odd_rows), shingle, share).collect()), key=repr)
    assert got == want


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert [r.kept for r in near_dedup.near_duplicates(frame(spark, [(1, None), (2, "")])).collect()] == [True, True]


def test_second_round_finds_links_between_parts(spark):
    """A chain in which only neighbours are linked: no single head meets all."""
    r = random.Random(9)
    w = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w)))
        for k in range(4):
            w[(i * 16 + k * 4) % 200] = f"n{i}.{k}"
    assert {x.component_id for x in near_dedup.near_duplicates(frame(spark, rows), 3, 85).collect()} == {0}


def test_blocks_compare_every_pair_once(spark, monkeypatch):
    """Small blocks and chunks against all pairs; sketches have negative longs too, and Arrow batches end within groups."""
    share, r, words = 85, random.Random(3), near_dedup.MORE_BITS // 64
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(near_dedup, "PAIRS", 7)
    most = near_dedup.farthest(share, near_dedup.MORE_SAMPLES, near_dedup.MORE_BITS)
    base = [r.getrandbits(64) for _ in range(words)]
    rows, members = [], []
    for i in range(60):
        sketch = list(base)
        for bit in r.sample(range(words * 64), r.choice((0, most // 2, most // 2 + 60))):
            sketch[bit // 64] ^= 1 << (bit % 64)
        bands = [b * 10 + (0 if b % 3 else r.randrange(4)) for b in range(near_dedup.BANDS)]
        rows.append((i, [x - (1 << 64) if x >> 63 else x for x in sketch], r.choice((100, 95, 70)), 100, bands))
        members += [(bands[b], i, i % 5) for b in (0, 1, 2, 3, 5)]
    sizes = {k: sum(m[0] == k for m in members) for k, _, _ in members}
    more = spark.createDataFrame(rows, "id long, sketch array<long>, common long, n long, bands array<long>")
    open_ = spark.createDataFrame([(k, sizes[k], i, p) for k, i, p in members], "key long, size long, id long, part long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = [tuple(sorted(x)) for x in near_dedup.compared(near_dedup.in_blocks(open_), more, share).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {(k, i) for k, i, _ in members}
    want = []
    for a, x, ca, na, ba in rows:
        for b, y, cb, nb, bb in rows[a + 1 :]:
            first = next((k for k, m in zip(ba, bb) if k == m), None)
            low, apart = min(ca, cb), sum(((u ^ v) & (2**64 - 1)).bit_count() for u, v in zip(x, y))
            if a % 5 != b % 5 and (first, a) in held and (first, b) in held and 100 * low >= share * (na + nb - low) and apart <= most:
                want.append((a, b))
    assert 50 < len(want) < 1000 and sorted(got) == want


def brute_lines(rows, share=80):
    earlier, out = [], {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        for j, line in enumerate((t or "").split("\n")):
            if s := frozenset(words(line)):
                out[d, j] = any(linked(s, e, share) for e in earlier)
                earlier.append(s)
    return out


def test_lines(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = [(1, None), (2, ""), (3, " \n\n ")]
    for d in range(10, 40):
        own = []
        for _ in range(6):
            w = r.choice(lines).split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = "new"
            own.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
        rows.append((d, "\n".join(own)))
    docs = frame(spark, rows).repartition(3)
    got = {(x.did, x.line): x.removed for x in line_dedup.marked_lines(docs).collect()}
    want = brute_lines(rows)
    assert got == want
    with monkeypatch.context() as m:  # every token is a large one, in small blocks; then few candidates at first
        for name, value in (("TOGETHER", 0), ("PART", 10**9), ("BLOCK_ROWS", 3), ("PACKED", 50), ("PAIRS", 11)):
            m.setattr(line_dedup, name, value)
        assert {(x.did, x.line): x.removed for x in line_dedup.marked_lines(docs).collect()} == want
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "NEAREST", 1)
        m.setattr(line_dedup, "UNSURE", 1)
        assert {(x.did, x.line): x.removed for x in line_dedup.marked_lines(docs).collect()} == want
    kept = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs).collect()}
    for d, t in rows:
        left = [x for j, x in enumerate((t or "").split("\n")) if not want.get((d, j))]
        if any(words(x) for x in left) or not words(t):
            assert (kept[d] or "") == "\n".join(left)
        else:
            assert d not in kept
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    """Rows of packed arrays are large: two thousand of them are no batch, and no row is lost."""
    docs = frame(spark, [(i, "ab " * 70_000) for i in range(200)]).coalesce(1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    out = common.texts(docs).mapInArrow(run, "n long, size long").collect()
    assert sum(x.n for x in out) == 200 and max(x["size"] for x in out) <= 1.1 * common.BATCH_BYTES


def test_entries_meet_part_by_part(monkeypatch):
    """The same pairs as of all entries at once, in much less memory; the nearest are those of all parts."""
    import tracemalloc

    monkeypatch.setattr(line_dedup, "PAIRS", 1 << 14)
    r = np.random.default_rng(5)
    e = np.zeros(160_000, line_dedup.ENTRY)
    e["token"], e["half"] = r.integers(0, 40_000, len(e), np.uint64), r.integers(0, 60_000, len(e), np.uint64)
    e["low"], e["high"] = (np.uint64(1) << e["half"] % np.uint64(64)) - np.uint64(1), 0
    e["did"], e["n"], e["pos"] = e["half"], 20, 0
    split = lambda k: {i: [x] for i in range(k) if len(x := e[e["token"] % np.uint64(k) == i])}
    got, peaks = [], []
    for k in (1, 16):
        parts = split(k)
        tracemalloc.start()
        a, b, tokens, more = line_dedup.met(parts, 80)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        got.append((set(zip(a.tolist(), b.tolist())), set(zip(tokens.tolist(), more.tolist()))))
        assert not parts
    assert got[0] == got[1] and len(got[0][0]) > 1000 and len(got[0][1]) > 0
    assert peaks[1] < 0.6 * peaks[0], peaks
    assert [len(x) for x in line_dedup.met({}, 80)] == [0] * 4


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (100, 20), (1000, 100)])
def test_bpe(spark, odd_rows, chunk, overlap):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    one = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    r = random.Random(2)
    pool = ["a", "b ", " ", "\n", "\t", "\r\n", "'s", "'re", "'", "é", "1", "22", "!", "%%", "😀", "　", "x" * 40, "   \n\n  ", "\xa0", "\x85"]
    rows = [(i, t) for i, t in odd_rows if i != 307] + [(1000 + i, "".join(r.choice(pool) for _ in range(r.randint(1, 900)))) for i in range(60)]
    want = sorted(((d, np.array(one.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in rows), key=repr)
    first = bpe.encode(frame(spark, rows), path, public_tokenizers.PATTERN, chunk, overlap)
    assert sorted(((x.doc_id, bytes(x.ids), bytes(x.decoded)) for x in bpe.decode(first, path).collect()), key=repr) == want
    both = bpe.encode(frame(spark, rows), path, public_tokenizers.PATTERN, chunk, overlap, decoded=True)
    assert sorted(((x.doc_id, bytes(x.ids), bytes(x.decoded)) for x in both.collect()), key=repr) == want
    assert bpe.encode(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_moves_cuts_past_long_runs(spark):
    """Runs of letters and of spaces longer than the overlap stand at the usual cuts."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    one = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    r = random.Random(6)
    plain = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    text = plain(60) + " " + "x" * 700 + " " + plain(60) + " " * 700 + plain(60) + "".join(" " + plain(40) for _ in range(30))
    out = bpe.encode(frame(spark, [(1, text)]), path, public_tokenizers.PATTERN, 500, 50).collect()
    assert bytes(out[0].ids) == np.array(one.encode_ordinary(text), "<u4").tobytes()


def test_token_store(spark, odd_rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    one = Tokenizer.from_file(path)
    manifest = token_store.write(frame(spark, odd_rows), path)
    got = sorted((tuple(x) for x in token_store.read(manifest).collect()), key=lambda x: x[1])
    assert len(got) == len(odd_rows) and [x[0] for x in got] == sorted((d for d, _ in odd_rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    ids = {d: one.encode(t or "", add_special_tokens=False).ids + [1] for d, t in odd_rows if d is not None}
    for d, _, n, crc in got:
        if d is not None:
            assert (n, crc) == (len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes()))
    shards = [token_store.ShardReader(x.path) for x in manifest.collect()]
    found = [y.tolist() for s in shards for y in s.get(3)]
    assert found == [ids[3]] * 3 and not [y for s in shards for y in s.get(10**15)]
    assert token_store.read(token_store.write(frame(spark, []), path)).count() == 0


def test_word_encoder_gives_the_library_s_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    one, r = Tokenizer.from_file(path), random.Random(11)
    pool = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", "<|", "|>", "Ab", "word", "WORD.", "x,", ".", ",", "'s", "it's", "12", " ", "\n", "\t", "\r\n", "é", "É", "ſ", "İ", "😀", "　", "\xa0", "-", "..", "A"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    want = [np.array(e.ids + [1], "<u2").tobytes() for e in one.encode_batch(texts, add_special_tokens=False)]
    assert token_store.word_encoder(path, 1, 2)(texts) == want


def test_shards_end_at_their_bounds(spark, odd_rows, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = sorted((tuple(x) for x in token_store.read(token_store.write(frame(spark, odd_rows), path)).collect()), key=repr)
    monkeypatch.setattr(token_store, "SHARD_DOCS", 7)
    monkeypatch.setattr(token_store, "SHARD_BYTES", 5000)
    manifest = token_store.write(frame(spark, odd_rows), path)
    assert manifest.count() > 10 and max(x.n_docs for x in manifest.collect()) <= 7
    assert sorted((tuple(x) for x in token_store.read(manifest).collect()), key=repr) == whole


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20000))
    assert sorted(token_store.PerfectHash.build(keys)(keys).tolist()) == list(range(len(keys)))


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, odd_rows):
    r = random.Random(3)
    pool = ["token", "secret", "=", ":", " ", '"', "AKIA", "ABCD1234EFGH", "0123456789abcdef", "é", "😀", "api_key", "PassWord", ".", "zz", "\n", "12345678", "idſecret"]
    rows = [*odd_rows, *((2000 + i, "".join(r.choice(pool) for _ in range(r.randint(1, 60)))) for i in range(400))]
    found = secrets.scan(frame(spark, rows)).select("doc_id", secrets.written(F.col("base")).alias("b")).collect()
    assert sorted(((x.doc_id, x.b) for x in found), key=repr) == sorted(((d, brute_spans(t or "")) for d, t in rows), key=repr)
    assert secrets.scan(frame(spark, [])).count() == 0


def test_random_strings_are_found(spark):
    r = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "see " + "".join(r.choice(letters) for _ in range(40)) + " there") for i in range(30)]
    rows += [(100 + i, "see " + "-".join(r.choice(["section", "chapter", "thing", "house"]) for _ in range(5)) + "2 there") for i in range(30)]
    found = {x.doc_id for x in secrets.scan(frame(spark, rows)).where("size(found) > 0").collect()}
    assert len(found & set(range(30))) >= 27 and not found & set(range(100, 130))


def test_recall_of_each_encoding(spark):
    """60 planted keys of each kind among prose and identifiers: at least nine in ten are found, and no identifier."""
    r = random.Random(21)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    up, both = low.upper(), low.upper() + low + digits
    kinds = [(both, 20), (both, 24), (both, 32), (both, 40), (digits + "abcdef", 24), (digits + "ABCDEF", 32), (up + "234567", 26), (low + "234567", 32), (low + up, 40), (low + up, 24), (low + digits, 24), (up + digits, 24), (both + "+/", 40), (both + "-_", 43)]
    rows = [(1000 * k + i, "see " + "".join(r.choice(symbols) for _ in range(n)) + " there") for k, (symbols, n) in enumerate(kinds) for i in range(60)]
    prose = ["section", "chapter", "thing", "house", "weather", "morning", "people", "water", "Value", "Handler", "user", "name", "test", "token", "Index", "of", "2024", "v2"]
    rows += [(50000 + i, "see " + r.choice("-_/+").join(r.choice(prose) for _ in range(r.randint(4, 8))) + " there " + "".join(r.choice(prose).title() for _ in range(5))) for i in range(300)]
    base = set()
    found = set()
    for x in secrets.scan(frame(spark, rows)).collect():
        found |= {x.doc_id} if x.found else set()
        base |= {x.doc_id} if x.base else set()
    recall = {(k, symbols[:3] + symbols[-3:], n): len((found | base) & set(range(1000 * k, 1000 * k + 60))) / 60 for k, (symbols, n) in enumerate(kinds)}
    assert min(recall.values()) >= 0.9, recall
    assert len([x for x in found if x >= 50000]) <= secrets.FALSE_SHARE * len(found)


def test_false_discoveries_step(spark, monkeypatch):
    """The step over counts is that of Benjamini and Hochberg over single p-values, by length."""
    r = random.Random(2)
    rows = []
    for i in range(300):
        share, size = r.random() ** 0.5, r.choice((22, 40))
        rows.append((i, "".join(r.choice("abcdefghij0123456789ABCDEF") if r.random() < share else "e" for _ in range(size)) + " x"))
    base = F.array().cast("array<struct<s:int,k:int,e:int>>")
    single = [(x.doc_id, m.length, m.grid) for x in common.texts(frame(spark, rows)).select("doc_id", secrets.candidates(F.col("text"), base).alias("more")).collect() for m in x.more]
    want = set()
    for length in {m[1] for m in single}:
        own = sorted((10 ** (-g / secrets.GRID), d) for d, n, g in single if n == length)
        most = max((i + 1 for i, (p, _) in enumerate(own) if p <= 0.05 * (i + 1) / len(own)), default=0)
        want |= {d for p, d in own if most and p <= own[most - 1][0] and p < 1}
    got = {x.doc_id for x in secrets.scan(frame(spark, rows), 0.05).where("size(found) > 0").collect()}
    assert got == want and 0 < len(want) < len(single)


def test_long_random_strings_of_any_alphabet_are_found(spark):
    r = random.Random(12)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both = low.upper() + low + digits
    kinds = [(low + digits, 64), (low + digits, 128), (low.upper() + digits, 64), (low + "234567", 64), (both, 1000), (both + "+/", 2400), (both + "-_", 2400)]
    kinds += [("123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", 1000), ("0123456789abcdefghjkmnpqrstvwxyz", 1000)]
    rows = [(100 * k + i, "see " + "".join(r.choice(symbols) for _ in range(n)) + " there") for k, (symbols, n) in enumerate(kinds) for i in range(20)]
    prose = ["section", "chapter", "thing", "house", "weather", "morning", "people", "water"]
    rows += [(5000 + i, "see " + "".join(r.choice(prose) + r.choice(digits) * (r.random() < 0.3) for _ in range(n)) + "2 there") for i, n in enumerate((4, 10, 20, 150, 400) * 6)]
    found = {x.doc_id for x in secrets.scan(frame(spark, rows)).where("size(found) > 0").collect()}
    assert all(len(found & set(range(100 * k, 100 * k + 20))) >= 18 for k in range(len(kinds))) and not {x for x in found if x >= 5000}


def shards_of(spark, docs, path, shards=24):
    rows = common.materialize(sharding.sized(docs, shards), "t")
    sharding.store_map(sharding.balanced_map(sharding.slot_loads(rows), shards), path, 1)
    return rows, sharding.assign(rows, sharding.load_map(spark, path)).collect()


def test_sharding(spark, odd_rows, tmp_path):
    docs = frame(spark, [*odd_rows, *[(7777, "same row " * 50)] * 500, *[(8000 + i, "same text " * 30) for i in range(400)]])
    rows, out = shards_of(spark, docs, str(tmp_path / "a"))
    assert len(out) == docs.count() and {x.shard for x in out} <= set(range(24))
    for s in range(24):
        own = sorted(x.position for x in out if x.shard == s)
        assert own == list(range(len(own)))
    sizes = {d: len((t or "").encode()) + 8 for d, t in odd_rows}
    assert all(x["size"] == sizes[x.doc_id] for x in out if x.doc_id in sizes and x.doc_id is not None)
    repeated = [sum(x.shard == s for x in out if x.doc_id == 7777) for s in range(24)]
    assert max(repeated) < 100  # a row that repeats is spread
    # however the input is partitioned, the same rows are in the same shards
    for n, again in enumerate((docs.repartition(7), docs.orderBy("text").coalesce(2))):
        _, other = shards_of(spark, again, str(tmp_path / f"b{n}"))
        assert sorted(map(tuple, other), key=repr) == sorted(map(tuple, out), key=repr)
    second = sharding.with_one_more(sharding.load_map(spark, str(tmp_path / "a")), 24)
    first = sharding.load_map(spark, str(tmp_path / "a"))
    moved = first.alias("a").join(second.alias("b"), "slot").where("a.shard <> b.shard")
    assert moved.where("b.shard <> 24").count() == 0 and second.count() == first.count()
    sharding.store_map(second, str(tmp_path / "a"), 2)
    assert sharding.load_map(spark, str(tmp_path / "a")).first().version == 2 and sharding.load_map(spark, str(tmp_path / "a"), 1).first().version == 1
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.store_map(second, str(tmp_path / "a"), 2)
    # an edit for new loads moves few slots and balances
    loads = sharding.slot_loads(rows).withColumn("bytes", F.when(F.col("slot") % 10 == 0, F.col("bytes") * 3).otherwise(F.col("bytes")))
    third = sharding.rebalanced(second, loads, 25)
    assert third.count() == first.count() and third.first().version == 3
    assert shards_of(spark, frame(spark, []), str(tmp_path / "c"))[1] == []


def test_shards_are_near_equal_and_keep_equal_texts(spark, tmp_path):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    _, out = shards_of(spark, docs, str(tmp_path / "a"))
    loads, texts, of = [0] * 24, {x.doc_id: x.text for x in docs.collect()}, {}
    for x in out:
        loads[x.shard] += x["size"]
        of.setdefault(texts[x.doc_id], set()).add(x.shard)
    fair = sum(loads) / 24
    assert max(loads) - min(loads) <= 0.02 * fair
    heavy = {t for t in of if sum(len((u or "").encode()) + 8 for u in texts.values() if u == t) * 24 * sharding.OVER > sum(loads)}
    assert all(len(held) == 1 for t, held in of.items() if t not in heavy)
    # one text may be most of the table
    many = docs.select("doc_id", "text").unionByName(spark.range(10**6, 10**6 + 3000).select(F.col("id").alias("doc_id"), F.lit("copy " * 300).alias("text")))
    _, out = shards_of(spark, many, str(tmp_path / "b"))
    loads = [sum(x["size"] for x in out if x.shard == s) for s in range(24)]
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 24


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(40)]
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2050, [1.0, 2.0]), (None, [1.0] * 6), (2100, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    v = topk.integer_vectors(df)
    got = {}
    for x in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.score, x.vec_id)
    fine = {i: [int(np.floor(256 * float(np.float32(y)))) for y in w] for i, w in rows if i is not None and w is not None and None not in w and np.isfinite(w).all()}
    for q, a in fine.items():
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine.items() if i != q and len(a) == len(b))[:5]
            assert [got.get(q, {})[k] for k in sorted(got.get(q, {}))] == [(-s, i) for s, i in best]
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_top_k_of_huge_components_and_in_a_grid(spark, monkeypatch):
    r = random.Random(5)
    sizes = [1.0, 1e3, 3e7, 1e12, 1e25, 3e37]
    rows = [(i, [r.choice((-1, 1)) * r.random() * r.choice(sizes[: 1 + i % 6]) for _ in range(5)]) for i in range(150)] + [(500 + i, [2.0**100] * 5) for i in range(7)] + [(510, [-(2.0**100)] * 5)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    fine = {i: [int(np.floor(256 * float(np.float32(y)))) for y in w] for i, w in rows}
    cut = lambda x: min(2**63 - 1, max(-(2**63), x))
    want = set()
    for q, a in fine.items():
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine.items() if i != q)[:8]
            want |= {(q, n + 1, i, cut(-s)) for n, (s, i) in enumerate(best)}
    assert {tuple(x) for x in topk.top_k(v, v.where("vec_id % 50 = 0"), 8).collect()} == want
    for name, value in (("BROADCAST_BYTES", 150), ("CELL_BYTES", 4000), ("SHARD_BLOCK", 16), ("QUERY_BLOCK", 2)):
        monkeypatch.setattr(topk, name, value)
    assert {tuple(x) for x in topk.top_k(v, v.where("vec_id % 50 = 0"), 8).collect()} == want
    few = topk.integer_vectors(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3e7, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [tuple(x) for x in topk.top_k(few, few.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(0, 1, 1, 256 * 256 * 30000002), (0, 2, 2, 256 * 256 * 3)]


def test_decontamination(spark):
    docs, items = common.table(spark, DATA, "documents"), common.table(spark, DATA, "benchmark")
    item = items.where("item_id = 3").first().text
    w = item.split()
    w[len(w) // 2] = "changed"
    text = docs.first().text
    planted = [(10**6, f"{text} {item} {text}", None), (10**6 + 1, text + "\n" + " ".join(w), None), (10**6 + 2, None, None), (10**6 + 3, "", None)]
    more = docs.select("doc_id", "text", F.lit(1).alias("item_id")).unionByName(spark.createDataFrame(planted, "doc_id long, text string, item_id int"))
    found = {(x.doc_id, x.item_id) for x in decontaminate.matches(more, items).collect()}
    assert {(10**6, 3), (10**6 + 1, 3)} <= found
    whole = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if " ".join(words(i.text)) in " ".join(words(d.text))}
    assert whole <= found and len(found) <= len(whole) + 6
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), items).count() == 0


def test_decontamination_against_the_best_subsequence_of_all_windows(spark):
    """On sf0.01, by brute force; then paraphrases that lose their rarest terms, or any."""
    docs, items = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "benchmark")
    known: dict = {}
    number = lambda text: [known.setdefault(w, len(known)) for w in decontaminate.terms(text or "")]
    held = [(x.item_id, number(x.text)) for x in items.collect()]
    want = set()
    for d in docs.collect():
        t = number(d.text)
        has = set(t)
        for i, x in held:
            if sum(y in has for y in x) >= 0.7 * len(x):  # no subsequence is longer
                masks, step = decontaminate.masks_of(x), max(1, len(x) // 4)
                if max(decontaminate.lcs(x, t[s : s + 2 * len(x)], masks) for s in range(0, len(t), step)) >= 0.7 * len(x):
                    want.add((d.doc_id, i))
    found = {(x.doc_id, x.item_id) for x in decontaminate.matches(docs, items).collect()}
    assert found == want and len(want) > 10
    r, often, planted, truth = random.Random(7), {}, [], {}
    for _, x in held:
        for w in set(x):
            often[w] = often.get(w, 0) + 1
    texts, all_items = [x.text for x in docs.limit(50).collect()], items.collect()
    for n in range(120):
        item = r.choice(all_items)
        w, m = item.text.split(), round(0.16 * len(item.text.split()))
        rare = sorted(range(len(w)), key=lambda k: often.get(known.get((decontaminate.terms(w[k]) or [b""])[0]), 0))[:m]
        for k in rare if n % 2 else r.sample(range(len(w)), m):
            w[k] = f"zzq{r.randrange(10**6)}"
        host = r.choice(texts).split()
        at = r.randrange(len(host) + 1)
        planted.append((10**6 + n, " ".join(host[:at] + w + host[at:])))
        truth[10**6 + n] = item.item_id
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {(x.doc_id, x.item_id) for x in decontaminate.matches(more, items).collect()}
    assert sum((d, i) in found for d, i in truth.items()) >= 0.9 * len(truth)


@pytest.mark.parametrize("x,y", [("abcbdab", "bdcaba"), ("", "abc"), ("aaa", "aa"), ("abcdefgh" * 20, "hgfedcba" * 30)])
def test_lcs(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    assert decontaminate.lcs([ord(c) for c in x], [ord(c) for c in y]) == t[-1][-1]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(x) for x in registry.QUERIES[name](spark, DATA).select(columns).collect()) == sorted(want.fetchall())


def auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a == 1], [b for a, b in zip(y, s) if a == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("name,label,least", [("op2_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.85)])
def test_held_out(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES[name](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert auc([x[label] for x in got], [x.score for x in got]) >= least
    assert all(0 <= x.score <= 1 for x in got)


@pytest.mark.parametrize("module,column", [(quality, "__quality"), (toxicity, "__toxicity")])
def test_scores_of_odd_rows(spark, odd_rows, module, column):
    model = module.train(common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels"))
    out = module.score(frame(spark, odd_rows), model).collect()
    assert len(out) == len(odd_rows) and all(0 <= x[column] <= 1 for x in out)
    none = module.train(frame(spark, []), common.table(spark, DATA, "labels"))
    assert all(0 <= x[column] <= 1 for x in module.score(frame(spark, odd_rows[:3]), none).collect())


def test_marginals_against_all_labelings():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        emit, trans = r.normal(size=n) * 2, r.normal(size=(2, 2))
        total, bad, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            p = np.exp(sum(e for e, k in zip(emit, y) if k) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += p
            bad += p * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += p
        got, found = quality.marginals([emit, emit[:1]], trans)
        assert np.allclose(got[0], bad / total) and np.allclose(found, pairs / total) and len(got[1]) == 1


def test_the_bound_of_learned_rows_holds(spark):
    rows = [(i, f"some text {i}") for i in range(40)] + [(0, f"again {i}") for i in range(300)] + [(1, "same")] * 300
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    none = F.lit(False)
    found = common.labelled(frame(spark, rows), labels, "toxic", none, 10)
    got = common.one_each(found, ["y", "key"])
    assert len(got) == 10 and common.one_each(common.labelled(frame(spark, rows), labels, "toxic", none, 1000), ["y", "key"]).num_rows == 39  # 2 has both labels
    again = common.one_each(common.labelled(frame(spark, rows).repartition(5), labels, "toxic", none, 10), ["y", "key"])
    assert again.equals(got)


def test_the_penalty_lowers_false_positives_on_neutral_mentions(spark):
    """Toxic texts name one group more often; neutral texts that name it must not suffer from that."""
    r = random.Random(4)
    fill, rude = [f"w{i}" for i in range(300)], ["idiot", "scum", "trash", "moron"]

    def text(group, bad):
        own = [r.choice(fill) for _ in range(25)] + ["the", "of", "and", "is"] + [group] * (group != "") + ([r.choice(rude)] if bad and r.random() < 0.5 else [])
        r.shuffle(own)
        return " ".join(own)

    rows, labels = [], []
    for i in range(600):
        bad = i % 2 == 1
        group = ("women" if r.random() < 0.9 else "") if bad else ("men" if r.random() < 0.5 else "women" if r.random() < 0.08 else "")
        rows.append((i, text(group, bad)))
        labels.append((i, 1, int(bad)))
    docs, held = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    neutral = frame(spark, [(i, text("women", False)) for i in range(200)])
    rate = lambda penalty: sum(x["__toxicity"] >= 0.7 for x in toxicity.score(neutral, toxicity.train(docs, held, penalty=penalty)).collect()) / 200
    without, with_ = rate(0.0), rate(toxicity.PENALTY)
    assert without > 0.5 and with_ < 0.2 * without


def test_swaps_change_identity_features_of_the_own_language():
    assert toxicity.language("the cat of the house") == "en" and toxicity.language("der Hund und die Katze") == "de" and toxicity.language("zzz") is None
    assert toxicity.swapped("She, the Woman", toxicity.IDENTITY_SWAPS["en"]) == "he, the man"


def test_swapping_terms_hardly_changes_a_score(spark):
    text = "such awful people are idiot and trash said the women"
    rows = [(i, text if i % 2 else "a calm and friendly report about the town") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, rows), labels)
    a, b = [x["__toxicity"] for x in toxicity.score(frame(spark, [(1, "the women came"), (2, "the men came")]), model).collect()]
    assert abs(a - b) < 0.1


def test_pipeline(spark):
    docs = common.table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, DATA), "t")
        assert out.count() <= before
        if name != "bpe":
            assert out.columns == columns
        if name == "near_dedup":
            kept = [shingle_set(x.text, 5) for x in out.collect()]
            assert not any(linked(kept[i], kept[j], 80) for i in range(len(kept)) for j in range(i))
        if name == "bpe":
            texts = {x.doc_id: x.text for x in docs.collect()}
            assert all(x.decoded_sha256 == hashlib.sha256((texts[x.doc_id] or "").encode()).hexdigest() for x in out.collect())
        docs, before = out, out.count()
    assert corpus_pipeline.run(spark, DATA).count() == before


def test_pipeline_stages_tell_rows_with_null_and_repeated_ids_apart(spark):
    r = random.Random(6)
    a, b, c, d = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " x"), (5, b), (5, b), (5, c), (7, c), (4, b), (None, d), (None, None), (None, None), (8, ""), (8, "")]
    out = corpus_pipeline.dedup_documents(spark, frame(spark, rows), DATA)
    assert out.columns == frame(spark, []).columns
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=repr)
    left = [x for x in got if x[1] not in (a, a + " x")]
    assert left == sorted([(4, b), (5, c), (None, d), (None, None), (None, None), (8, ""), (8, "")], key=repr) and len(got) == len(left) + 1
    item = common.table(spark, DATA, "benchmark").where("item_id = 3").first().text
    rows = [(None, f"{a} {item} {b}"), (None, c), (9, item), (9, d), (9, d), (1, a)]
    out = corpus_pipeline.decontaminate_documents(spark, frame(spark, rows), DATA)
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=repr) == sorted([(None, c), (9, d), (9, d), (1, a)], key=repr)


def test_pipeline_stages_on_odd_rows_and_nothing(spark, odd_rows):
    """Each stage on nulls, empty and very long texts, repeats and columns that are named like its own, and on no rows."""
    wide = frame(spark, odd_rows).withColumns({c: F.lit(i) for i, c in enumerate(["__toxicity", "__key", "__did", "__dk", "__n", "__gone", "component", "text_hash", "n_chars"])})
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, wide, DATA), "t")
        none = stage(spark, wide.limit(0), DATA)
        assert none.count() == 0
        if name == "bpe":
            assert out.count() == len(odd_rows) and [x.n_tokens for x in out.where("doc_id IN (300, 301)").collect()] == [0, 0]
            continue
        assert out.columns == wide.columns and none.columns == wide.columns
        held = out.collect()
        assert {x.text for x in held} <= {t for _, t in odd_rows} if name != "line_dedup" else all(x.text is None or x.text.count("\n") < 900 for x in held)
        assert all(x["__key"] == 1 and x["__gone"] == 5 and x.component == 6 for x in held)
        assert sum(x.doc_id in (300, 301, 302) for x in held) == 3  # texts without words stay
