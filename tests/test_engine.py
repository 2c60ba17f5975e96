"""Text queries, plans, relation files, index, registers and boundary on small inputs with known answers."""

import io

import pytest
from pyspark.sql import functions as F

from sluice import drivers
from sluice.functions import unsigned
from sluice.operators import boundary, generators, index, registers
from sluice.plans import workload
from sluice.plans.planner import answer, execute, joined
from sluice.plans.spec import QueryError, QuerySpec
from sluice.sources import relation_io, storage
from sluice.sources.catalog import Catalog, table_catalog


@pytest.fixture(scope="module")
def ten(spark):
    out = Catalog()
    for _ in range(5):
        out.add(relation_io.generated(spark, 10, 3))
    return out


#: Queries over five relations of ten rows whose columns all hold the row's number, and their answers.
GOLDEN = [
    ("1 2|0.0=1.1|1.2", "45"),
    ("0 2 3|0.0=1.1&1.2=2.0|2.2", "45"),
    ("0 1 4|0.0=1.1&1.2=2.0&1.1=4|1.0 2.2", "4 4"),
    ("0 1 2|0.0=1.1&1.2=2.0&1.1=100|1.0 2.2", "NULL NULL"),
    ("0 0|0.0=1.1|1.0", "45"),
    ("0 1 2|0.0=1.1&1.1=2.0&2.2=0.1|1.0", "45"),
    ("0 1 2 3|0.0=1.1&1.1=2.0&2.2=3.1|1.0", "45"),
    ("0 1 2 3|0.0=1.1&2.1=3.0&0.2=2.1|1.0", "45"),
    ("0 1|0.0=1.1&0.0=3&1.0=3|1.0", "3"),
    ("0 1|0.0=1.1&0.0<3&1.0>3|1.0", "NULL"),
    ("0 1|0.0=1.1&0.0>1&0.0<3|1.0", "2"),
]


@pytest.mark.parametrize("text,want", GOLDEN)
def test_golden(ten, text, want):
    spec = QuerySpec.parse(text)
    assert answer(execute(spec, ten)) == want
    assert answer(execute(spec, ten, ordered=True)) == want


def test_workload(ten):
    lines = [x for t, _ in GOLDEN[:4] for x in (t,)] + ["F", GOLDEN[4][0], "F"]
    assert workload.run_workload(lines, ten) == [a for _, a in GOLDEN[:5]]
    took, wrong = workload.check_workload(lines, [*(a for _, a in GOLDEN[:4]), "46"], ten)
    assert took > 0 and wrong == [(4, "46", "45")]


def test_sql_of_queries(monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", io.StringIO("0 2|0.1=1.1&0.0=1.0&0.1=5|0.1 1.4\nF\n"))
    workload.main(["sql"])
    assert capsys.readouterr().out == 'SELECT SUM("0".c1), SUM("1".c4) FROM r0 "0", r2 "1" WHERE "0".c1="1".c1 and "0".c0="1".c0 and "0".c1=5;\n'


#: The texts of the next two tests are fixed values too.
def test_parser():
    spec = QuerySpec.parse("0 2 4|0.1=1.1&0.0=2.1&1.0=2.0&1.0>3|0.1 1.4 2.2")
    assert spec.relations == (0, 2, 4) and len(spec.joins) == 3 and len(spec.filters) == 1 and str(spec.selections[1]) == "1.4"
    text = "0 2|0.1=1.1&0.0=1.0&1.2=3|0.1 1.4"
    assert QuerySpec.parse(text).to_text() == text


@pytest.mark.parametrize("text", ["0 1|0.0<1.1|0.0", "0|0.0<=3|0.0", "0|0.0=-5|0.0", "0|0.0=1.5.2|0.0", "0 1|0.0=2.1|0.0", "0|0.0=1", "0||", "x|0.0=1|0.0", f"0|0.0={1 << 64}|0.0", "0|3=0.0|0.0"])
def test_refused_texts(text):
    with pytest.raises(QueryError):
        QuerySpec.parse(text)


@pytest.mark.parametrize("text", ["0 1|0.0=3|0.0", "0 1 2|0.0=1.0|0.0", "0 1 2 3|0.0=1.0&2.0=3.0|0.0", "0|0.0=1|0.7"])
def test_refused_plans(ten, text):
    with pytest.raises(QueryError):
        execute(QuerySpec.parse(text), ten)
    with pytest.raises(ValueError):
        execute(QuerySpec.parse("9|0.0=1|0.0"), ten)


def test_cross_only_if_allowed(ten):
    assert answer(execute(QuerySpec.parse("0 1|0.0=3|0.0"), ten, allow_cross=True)) == "30"
    assert answer(execute(QuerySpec.parse("0 1|0.0=0.1&0.0=1.0|0.0"), ten)) == "45"


@pytest.mark.parametrize("strategy,node", [("broadcast", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin")])
def test_duplicates_on_both_sides(spark, strategy, node):
    c = Catalog()
    c.add(spark.createDataFrame([(1,), (1,), (2,)], "a long"))
    c.add(spark.createDataFrame([(1,), (1,), (1,), (3,)], "a long"))
    rows = joined(QuerySpec.parse("0 1|0.0=1.0|0.0"), c, strategy=strategy)
    assert rows.count() == 6 and node in rows._jdf.queryExecution().toString()


def test_unsigned(spark):
    c = Catalog()
    c.add(spark.createDataFrame([(-1,), (5,), (-(2**63),)], "a long"), wide=True)
    assert answer(execute(QuerySpec.parse("0|0.0>5|0.0"), c)) == str((2**64 - 1 + 2**63) % 2**64)
    assert answer(execute(QuerySpec.parse(f"0|0.0={2**64 - 1}|0.0"), c)) == str(2**64 - 1)
    assert [int(r[0]) for r in c[0].select(unsigned.to_unsigned(F.col("c0"))).collect()] == [2**64 - 1, 5, 2**63]


def test_scan_prunes_and_pushes(spark):
    spec = QuerySpec.parse("6|0.3>3|0.1")
    plan = execute(spec, table_catalog(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "GreaterThan(l_linenumber,3)" in plan and "l_quantity" not in plan.split("Physical Plan")[1]


def test_relation_files(spark, tmp_path):
    for rows, columns in ((1000, 5), (0, 2)):
        path = str(tmp_path / f"r{rows}")
        relation_io.write_relation(relation_io.generated(spark, rows, columns), path)
        got = relation_io.read_relation(spark, path)
        assert got.columns == [f"c{i}" for i in range(columns)] and sorted(map(tuple, got.collect())) == [(i,) * columns for i in range(rows)]
    assert relation_io.header(path) == (0, 2)
    assert relation_io.to_parquet(spark, str(tmp_path / "r1000"), str(tmp_path / "p")).count() == 1000
    (tmp_path / "short").write_bytes(b"x")
    with pytest.raises(ValueError):
        relation_io.header(str(tmp_path / "short"))
    assert relation_io.store_all(relation_io.generated(spark, 3, 2), str(tmp_path), 7) == "r7"
    lines = sorted(x.value for x in spark.read.text(str(tmp_path / "r7.tbl")).collect())
    assert lines == ["0|0|", "1|1|", "2|2|"]
    assert (tmp_path / "r7.sql").read_text() == "CREATE TABLE r7 (c0 bigint,c1 bigint);\ncopy r7 from 'r7.tbl' delimiter '|';\n"


def log_of(spark, ops):
    return spark.createDataFrame([(i, o[0], 1, int(o[1:])) for i, o in enumerate(ops)], "seq long, op string, key long, value long")


def pairs(df):
    return sorted((r.key, r.value) for r in df.collect())


def test_replays(spark):
    assert pairs(index.replay_unique(log_of(spark, ["I10", "I11", "D11", "D10", "I12"]))) == [(1, 12)]
    assert pairs(index.replay_unique(log_of(spark, ["I1", "D1"]))) == []
    assert [r.ok for r in index.success(log_of(spark, ["I3", "I3", "D3", "D3"])).orderBy("seq").collect()] == [True, False, True, False]


def test_inserts_by_many_writers(spark):
    rows = spark.range(4 * 256).select((F.col("id") % 256).alias("key"), F.col("id").alias("value"))
    empty = rows.limit(0)
    many = index.insert(empty, rows)
    assert {r.n for r in index.key_histogram(many).collect()} == {4}
    assert index.size(index.insert(empty, rows, unique=True)).first().size == 256
    assert index.delete(many, rows).count() == 0
    stopped = index.conditional_insert(many, rows.withColumn("value", F.col("value") + 5000), lambda v: v >= 0)
    assert stopped.count() == 1024
    assert index.ordered(many, 255).count() == 4
    assert {(r.key, r.before, r.after) for r in index.neighbours(many, 7).collect()} == {(k, k - 1 if k else None, k + 1 if k < 255 else None) for k in range(256)}


def test_compact(spark, tmp_path):
    base = spark.createDataFrame([(1, 1), (2, 2)], "key long, value long")
    log = spark.createDataFrame([(1, "D", 1, 1), (2, "I", 3, 3)], "seq long, op string, key long, value long")
    assert pairs(index.compact(base, log, str(tmp_path / "c"))) == [(2, 2), (3, 3)]


def test_neighbours_at_the_ends_of_longs(spark):
    keys = [-(2**63), -(2**63) + 1, -5, 0, 7, 2**63 - 2, 2**63 - 1]
    rows = spark.createDataFrame([(k, 1) for k in keys], "key long, value long")
    got = {r.key: (r.before, r.after) for r in index.neighbours(rows, 4).collect()}
    assert got == {k: (keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)}
    skewed = spark.range(2000).select((F.col("id") * F.col("id") * F.col("id")).alias("key"), F.lit(1).alias("value"))
    got = {r.key: r.after for r in index.neighbours(skewed, 16).collect()}
    assert all(got[i**3] == ((i + 1) ** 3 if i < 1999 else None) for i in range(2000)) and index.neighbours(rows.limit(0)).count() == 0


def test_counters(spark):
    got = index.counters(log_of(spark, ["I3", "I3", "D3", "D3", "I4"])).first()
    assert (got.inserts, got.inserted, got.deletes, got.deleted) == (3, 2, 2, 1)


def test_segmented_index(spark, tmp_path):
    held = index.SegmentedIndex(spark, f"file://{tmp_path}/x", index.Thresholds(log_share=0.6, segments=3))
    assert pairs(held.state()) == [] and held.append(log_of(spark, ["I1", "I2", "I3", "I4"]))
    assert not held.append(log_of(spark, ["D1", "I9"])) and pairs(held.state()) == [(1, 2), (1, 3), (1, 4), (1, 9)]
    assert held.append(log_of(spark, ["D2"])) and pairs(held.state()) == [(1, 3), (1, 4), (1, 9)]
    before = set(held.files.names())
    gone = held.vacuum()
    assert pairs(held.state()) == [(1, 3), (1, 4), (1, 9)] and set(held.files.names()) == before - set(gone) and len(gone) == 8
    assert held.vacuum() == []


def test_old_intermediate_tables_go(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/sluice-some-0")
    (tmp_path / "other").mkdir()
    folder = f"file://{tmp_path}"
    assert storage.clean(spark, folder=folder) == [] and storage.clean(spark, -60.0, folder) == ["sluice-some-0"] and (tmp_path / "other").exists()


def test_write_events(spark):
    writes = spark.createDataFrame([(1, 4, 0, 10, 30), (2, 3, 1, 20, 25), (5, 6, 9, 30, 40)], "start long, finish long, writer long, lsn long, written long")
    log = boundary.write_events(writes, 8)
    points = [boundary.boundary(boundary.latest_slots(log.where(F.col("seq") <= t))).first().rlb for t in range(1, 7)]
    assert points == [10, 10, 10, 30, 30, 40] and {r.pid for r in log.collect()} == {1, 2}


def test_drivers(spark):
    counts, took = drivers.update_and_scan(spark, 3, 0.0, 300)
    assert took > 0 and {r.tid: r.updates for r in counts.collect()} == {0: 100, 1: 100, 2: 100}
    for alpha in (0.0, 1.0):
        got = drivers.insert_and_read(spark, 500, alpha, 200)
        assert got["found"] == 200 and got["insert_s"] > 0


def test_load_and_stop(spark, tmp_path, ten):
    for n in (3, 5):
        relation_io.write_relation(relation_io.generated(spark, n, 2), str(tmp_path / f"r{n}"))
    catalog = workload.load(spark, [f"{tmp_path}/r5\n", f"{tmp_path}/r3\n", "Done\n", "0|0.0=1|0.0\n"])
    assert [df.count() for df in catalog.frames] == [5, 3]
    took, wrong = workload.check_workload([GOLDEN[0][0], "F", GOLDEN[4][0], "F"], ["1", "2"], ten, most=1)
    assert wrong == [(0, "1", "45")]
    with pytest.raises(Exception, match="no nulls"):
        relation_io.write_relation(spark.createDataFrame([(None,)], "a long"), str(tmp_path / "bad"))


@pytest.mark.parametrize("n", [1, 2, 8, 32])
def test_registers(spark, n):
    log = spark.createDataFrame([(s, s % n, s * 3) for s in range(100)], "seq long, tid long, value long")
    before = {r.tid: r.version for r in registers.full_snapshot(spark, log, n, 40).collect()}
    after = {r.tid: (r.version, r.value) for r in registers.full_snapshot(spark, log, n, 70).collect()}
    assert len(after) == n and all(after[t][0] >= v for t, v in before.items()) and sum(v for v, _ in after.values()) == 71
    grown = registers.update(log, spark.createDataFrame([(0, 7, 1), (0, 8, 2)], "tid long, value long, order int"))
    last = {r.tid: (r.version, r.value) for r in registers.snapshot(grown).collect()}
    many = registers.update(log, spark.range(500).select((F.col("id") % n).alias("tid"), F.col("id").alias("value"), (499 - F.col("id")).alias("order")).repartition(3))
    assert sorted((r.seq, r.value) for r in many.where("seq > 99").collect()) == [(100 + i, 499 - i) for i in range(500)]
    assert last[0][1] == 8 and last[0][0] == {r.tid: r.version for r in registers.snapshot(log).collect()}[0] + 2


@pytest.mark.parametrize("slots,want", [([(1, True, 50), (2, False, 90), (0, True, 3)], 50), ([(1, False, 50), (2, False, 90)], 90), ([(0, True, 3)], 0)])
def test_boundary(spark, slots, want):
    assert boundary.boundary(spark.createDataFrame(slots, "pid long, is_working boolean, lsn long")).first().rlb == want


def test_generators(spark):
    a = [r.v for r in generators.zipf(spark, 1000, 1, 9, 1.0, 3).orderBy("id").collect()]
    assert a == [r.v for r in generators.zipf(spark, 1000, 1, 9, 1.0, 3).orderBy("id").collect()] and set(a) == set(range(1, 10))
    assert a.count(1) > 2 * a.count(4)
    flat = [r.v for r in generators.zipf(spark, 4000, 1, 4, 0.0, 3).collect()]
    assert all(800 < flat.count(v) < 1200 for v in range(1, 5))
    assert {r.v for r in generators.uniform(spark, 500, 1, 9, 3).collect()} == set(range(1, 10))
    assert abs(generators.gaussian(spark, 2000, 5.0, 1.0, 1).agg(F.avg("v")).first()[0] - 5) < 0.2
    assert generators.short_size(8192) == "8K"
