"""Queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import unsigned
from sluice.operators import boundary, generators, index, radix, registers
from sluice.plans import planner
from sluice.plans.spec import QuerySpec
from sluice.plans.workload import run_workload
from sluice.sources import relation_io
from sluice.sources.catalog import TABLES, Catalog, table_catalog
from sluice.sources.storage import shared_path
from sluice.streaming import logs

#: Text queries over the tables' integer columns, and options of their plans.
TEXTS: dict[str, tuple[str, dict]] = {
    "checksum_single": ("6|0.3>3|0.0 0.1", {}),
    "filter_conj": ("6|0.3>1&0.3<4&0.1>100|0.0 0.2", {}),
    "row_column_equality": ("6|0.1=0.2|0.0 0.1", {}),
    "join_binary": ("5 6|0.0=1.0&1.3=2|0.1 1.1", {}),
    "join_chain3": ("5 6 2|0.0=1.0&0.1=2.0&1.3>3|0.0 1.1 2.1", {}),
    "join_star4": ("6 5 4 3|0.0=1.0&0.1=2.0&0.2=3.0|1.1 2.1 3.1", {}),
    "join_broadcast": ("7 2|0.1=1.1|0.0 1.0", {"strategy": "broadcast"}),
    "join_shuffle_hash": ("7 2|0.1=1.1|0.0 1.0", {"strategy": "shuffle_hash"}),
    "join_sort_merge": ("7 2|0.1=1.1|0.0 1.0", {"strategy": "merge"}),
    "join_alias_self": ("6 6|0.0=1.0&0.3=1|0.0 1.1", {}),
    "join_multi_pred": ("6 6|0.0=1.0&0.1=1.1&0.2=1.2|0.0 1.3", {}),
    "join_cyclic": ("2 5 6 3|0.0=1.1&1.0=2.0&2.2=3.0&0.1=3.1|0.0 3.1", {}),
    "join_deferred_pred": ("5 6 2 1|2.1=3.0&0.0=1.0&0.1=2.0|0.0 3.1", {}),
    "join_ordered": ("5 6 2 1|2.1=3.0&0.0=1.0&0.1=2.0&1.3>3|0.0 3.1", {"ordered": True}),
    "join_empty_null": ("5 6|0.0=1.0&0.0=99999999|0.0 1.1", {}),
    "join_cross_allowed": ("0 1|0.0>0|0.0 1.1", {"allow_cross": True}),
}

_WITH = "WITH " + ", ".join(f"r{i} AS (SELECT {', '.join(f'CAST({c} AS BIGINT) AS c{k}' for k, c in enumerate(columns))} FROM {name})" for i, (name, columns) in enumerate(TABLES))
_LOG = "WITH log AS (SELECT event_id AS seq, CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN 'I' ELSE 'D' END AS op, user_id AS key, event_id % 10 AS value FROM events)"
_STATE = _LOG + ", state AS (SELECT key, value FROM (SELECT key, value, max_by(op, seq) AS op FROM log GROUP BY key, value) WHERE op = 'I')"
_SLOTS = "WITH log AS (SELECT event_id AS seq, user_id + 1 AS pid, event_type IN ('click', 'error') AS is_working, event_id AS lsn FROM events), slots AS (SELECT pid, max_by(is_working, seq) AS is_working, max_by(lsn, seq) AS lsn FROM log GROUP BY pid)"


def _text_query(text: str, options: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = QuerySpec.parse(text)
        out = planner.execute(spec, table_catalog(spark, sf_dir), **options)
        return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])

    return run


def _text_oracle(text: str) -> str:
    spec = QuerySpec.parse(text)
    plain = spec.to_sql().removesuffix(";")
    sums = ", ".join(f"CAST(SUM({s.sql}) AS BIGINT) AS s{i}" for i, s in enumerate(spec.selections))
    return f"{_WITH} SELECT {sums} {plain[plain.index('FROM'):]}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _op_log(rows: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type").isin("signup", "purchase", "view"), "I").otherwise("D")
    return rows.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), (F.col("event_id") % 10).alias("value"))


def _register_log(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("event_id").alias("seq"), F.col("user_id").alias("tid"), F.col("event_id").alias("value"))


def _slot_log(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("event_id").alias("seq"), (F.col("user_id") + 1).alias("pid"), F.col("event_type").isin("click", "error").alias("is_working"), F.col("event_id").alias("lsn"))


def op_log(spark, sf_dir):
    return _op_log(events(spark, sf_dir))


def state(spark, sf_dir):
    return index.replay(op_log(spark, sf_dir))


def register_log(spark, sf_dir):
    return _register_log(events(spark, sf_dir))


def slots(spark, sf_dir):
    return boundary.latest_slots(_slot_log(events(spark, sf_dir)))


def scan_project(spark, sf_dir):
    return table_catalog(spark, sf_dir)[6].select("c0", "c1")


def _filter(op: str, value: int):
    return lambda spark, sf_dir: table_catalog(spark, sf_dir)[4].where(unsigned.compare(F.col("c1"), op, value))


def _wide(spark, sf_dir) -> DataFrame:
    """c0 of lineitem, shifted so that most values have the top bit."""
    return table_catalog(spark, sf_dir)[6].select((F.col("c0") - F.lit(1 << 62) - F.lit((1 << 62) - 1000)).alias("c0"))


def checksum_u64_wrap(spark, sf_dir):
    return _wide(spark, sf_dir).agg(unsigned.checksum(F.col("c0")).cast("string").alias("s0"))


def filter_unsigned(spark, sf_dir):
    return _wide(spark, sf_dir).where(unsigned.compare(F.col("c0"), ">", (1 << 63) + 5000, wide=True)).agg(F.count("*").alias("n"))


def filtered_cardinality(spark, sf_dir):
    spec, catalog = QuerySpec.parse("5 6 2|0.0=1.0&0.1=2.0&1.3>3&2.1<10|0.0"), table_catalog(spark, sf_dir)
    parts = [planner.scan(spec, catalog, b).agg(F.lit(b).alias("binding"), F.count("*").alias("n")) for b in range(3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def join_cost_rank(spark, sf_dir):
    """The equalities of a query in greedy order."""
    spec, catalog = QuerySpec.parse("5 6 2|0.0=1.0&0.1=2.0&1.3>3&2.1<10|0.0"), table_catalog(spark, sf_dir)
    counts = planner.cardinalities(spec, catalog)
    rows = [(i + 1, str(j), counts[j.left.binding] * counts[j.right.binding]) for i, j in enumerate(planner.greedy_order(spec, counts))]
    return spark.createDataFrame(rows, "place int, predicate string, cost long")


#: Fixed value: a query whose SQL and text must come out as given.
_SAMPLE = "0 2|0.1=1.1&0.0=1.0&0.1=5|0.1 1.4"


def query_to_sql(spark, sf_dir):
    return spark.createDataFrame([(QuerySpec.parse(_SAMPLE).to_sql(),)], "sql string")


def query_round_trip(spark, sf_dir):
    return spark.createDataFrame([(QuerySpec.parse("0 2|0.1=1.1&0.1<5&0.0=1.0|0.1 1.4").to_text(),)], "text string")


def ddl_text(spark, sf_dir):
    return spark.createDataFrame([(relation_io.table_statements(table_catalog(spark, sf_dir)[6], 6),)], "ddl string")


def relation_csv_lines(spark, sf_dir):
    return relation_io.bar_lines(table_catalog(spark, sf_dir)[2])


def relation_generated(spark, sf_dir):
    return relation_io.generated(spark, 1000, 3)


def relation_binary_roundtrip(spark, sf_dir):
    """A relation that is written as a file and read again."""
    path = shared_path(spark, "relation")
    relation_io.write_relation(table_catalog(spark, sf_dir)[1], path)
    return relation_io.read_relation(spark, path)


def workload_batches(spark, sf_dir):
    """A small workload through the batch runner; answers in order."""
    texts = ["5 6|0.0=1.0&1.3=2|0.1 1.1", "6|0.3>3|0.0 0.1", "5 6|0.0=1.0&0.0=99999999|0.0"]
    got = run_workload([texts[0], texts[1], "F", texts[2], "F"], table_catalog(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(got)), "place long, answer string")


def index_conditional_insert(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("user_id").alias("key"), (F.col("event_id") % 10 + 10).alias("value")).distinct()
    return index.conditional_insert(state(spark, sf_dir), rows, lambda v: v >= 8)


def _half(spark, sf_dir):
    log = op_log(spark, sf_dir)
    return index.replay(log.where("seq % 2 = 0")), log.where("seq % 2 = 1")


def _middle(spark, sf_dir) -> int:
    """A cut in the middle of the log."""
    return register_log(spark, sf_dir).agg(F.max("seq")).first()[0] // 2


def snapshot_full(spark, sf_dir):
    """All registers up to the largest one that writes, at the middle of the log."""
    log = register_log(spark, sf_dir)
    return registers.full_snapshot(spark, log, log.agg(F.max("tid")).first()[0] + 1, _middle(spark, sf_dir))


def rlb_flush_pointer(spark, sf_dir):
    return boundary.flush_pointers(spark.range(0, 20000, 1000).select(F.col("id").alias("request")), slots(spark, sf_dir))


def _zipf_table(spark, sf_dir):
    return generators.zipf_probabilities(spark, 20, 1.0)


def stream_snapshot_latest(spark, sf_dir):
    return logs.drained(logs.running_snapshot(_register_log(logs.stream_of(spark, f"{sf_dir}/events.parquet"))), "snapshot")


def stream_index_replay(spark, sf_dir):
    return logs.drained(logs.running_pairs(_op_log(logs.stream_of(spark, f"{sf_dir}/events.parquet"))), "pairs").where("op = 'I'").select("key", "value")


def stream_index_unique(spark, sf_dir):
    stream = logs.unique_pairs(_op_log(logs.stream_of(spark, f"{sf_dir}/events.parquet")))
    return logs.drained_updates(stream, "unique", lambda df: df.groupBy("key").agg(F.max_by("value", "seq").alias("value")).where("value IS NOT NULL"))


def stream_rlb(spark, sf_dir):
    return boundary.boundary(logs.drained(logs.running_slots(_slot_log(logs.stream_of(spark, f"{sf_dir}/events.parquet"))), "slots"))


QUERIES: dict = {name: _text_query(text, options) for name, (text, options) in TEXTS.items()} | {
    "scan_project": scan_project,
    "filter_eq": _filter("=", 7),
    "filter_gt": _filter(">", 40),
    "filter_lt": _filter("<", 5),
    "checksum_u64_wrap": checksum_u64_wrap,
    "filter_unsigned": filter_unsigned,
    "filtered_cardinality": filtered_cardinality,
    "join_cost_rank": join_cost_rank,
    "radix_histogram": lambda s, d: radix.histogram(table_catalog(s, d)[7], "c1"),
    "radix_prefix_sum": lambda s, d: radix.offsets(table_catalog(s, d)[7], "c1"),
    "query_to_sql": query_to_sql,
    "query_round_trip": query_round_trip,
    "ddl_text": ddl_text,
    "relation_csv_lines": relation_csv_lines,
    "relation_generated": relation_generated,
    "relation_binary_roundtrip": relation_binary_roundtrip,
    "workload_batches": workload_batches,
    "index_point_lookup": lambda s, d: index.lookup(state(s, d), 3),
    "index_value_set": lambda s, d: index.value_sets(state(s, d)).select("key", F.array_join("values", ",").alias("values")),
    "index_size": lambda s, d: index.size(state(s, d)),
    "index_range_scan": lambda s, d: index.ordered(state(s, d), 100),
    "index_full_scan": lambda s, d: index.ordered(state(s, d)),
    "index_reverse_scan": lambda s, d: index.ordered(state(s, d), reverse=True),
    "index_neighbors": lambda s, d: index.neighbours(state(s, d)),
    "index_insert": lambda s, d: index.insert(_half(s, d)[0], _half(s, d)[1].select("key", "value")),
    "index_insert_unique": lambda s, d: index.insert(index.replay(op_log(s, d).where("key % 2 = 0")), op_log(s, d), unique=True),
    "index_delete": lambda s, d: index.delete(state(s, d), op_log(s, d).where("seq % 3 = 0")),
    "index_conditional_insert": index_conditional_insert,
    "index_replay": state,
    "index_op_success": lambda s, d: index.success(op_log(s, d)),
    "index_replay_unique": lambda s, d: index.replay_unique(op_log(s, d)),
    "index_compact": lambda s, d: index.compact(*_compact_input(s, d), shared_path(s, "compact")),
    "index_key_histogram": lambda s, d: index.key_histogram(state(s, d)),
    "index_counters": lambda s, d: index.counters(op_log(s, d)),
    "snapshot_latest": lambda s, d: registers.snapshot(register_log(s, d)),
    "snapshot_asof": lambda s, d: registers.snapshot(register_log(s, d), _middle(s, d)),
    "snapshot_full": snapshot_full,
    "snapshot_update_counts": lambda s, d: registers.update_counts(register_log(s, d)),
    "snapshot_versions": lambda s, d: registers.versions(register_log(s, d)),
    "snapshot_embedded": lambda s, d: registers.at_cuts(register_log(s, d), 100),
    "snapshot_text": lambda s, d: registers.as_text(registers.snapshot(register_log(s, d), _middle(s, d))),
    "rlb_point": lambda s, d: boundary.boundary(slots(s, d)),
    "rlb_timeline": lambda s, d: boundary.timeline(_slot_log(events(s, d)), 100),
    "rlb_flush_pointer": rlb_flush_pointer,
    "rlb_active_slots": lambda s, d: boundary.active(slots(s, d)),
    "zipf_pmf": lambda s, d: _zipf_table(s, d).select("i", F.round("p", 6).alias("p")),
    "zipf_cdf": lambda s, d: _zipf_table(s, d).select("i", F.round("cdf", 6).alias("cdf")),
    "uniform_sample": lambda s, d: generators.uniform(s, 1000, 1, 9, 7),
    "zipf_sample": lambda s, d: generators.zipf(s, 1000, 1, 9, 1.0, 7),
    "gaussian_sample": lambda s, d: generators.gaussian(s, 1000, 5.0, 2.0, 7).select("id", F.round("v", 6).alias("v")),
    "sample_histogram": lambda s, d: generators.histogram(generators.zipf(s, 1000, 1, 9, 2.0, 7)),
    "stream_snapshot_latest": stream_snapshot_latest,
    "stream_index_replay": stream_index_replay,
    "stream_index_unique": stream_index_unique,
    "stream_rlb": stream_rlb,
}


def _compact_input(spark, sf_dir):
    log = op_log(spark, sf_dir)
    middle = log.agg(F.expr("cast(max(seq) / 2 as bigint)").alias("m"))
    tagged = log.crossJoin(F.broadcast(middle))
    return index.replay(tagged.where("seq <= m")), tagged.where("seq > m")


_SNAPSHOT = "SELECT user_id AS tid, count(*) AS version, max_by(event_id, event_id) AS value FROM events"
_MIDDLE = " WHERE event_id <= (SELECT max(event_id) // 2 FROM events)"
_UNIQUE = (
    _LOG.replace("WITH", "WITH RECURSIVE", 1)
    + ", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM log), f AS (SELECT key, i, CASE WHEN op = 'I' THEN value END AS held FROM n WHERE i = 1 UNION ALL"
    " SELECT n.key, n.i, CASE WHEN n.op = 'I' AND f.held IS NULL THEN n.value WHEN n.op = 'D' AND f.held = n.value THEN NULL ELSE f.held END FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1)"
    " SELECT key, max_by(held, i) AS value FROM (SELECT key, held, i, max(i) OVER (PARTITION BY key) AS m FROM f) WHERE i = m AND held IS NOT NULL GROUP BY key"
)
_DRAW = "(CAST('0x' || substr(md5('7:{}:' || range), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"
_ZIPF = (
    "WITH t AS (SELECT range AS i, sum(pow(range, -{0}.0)) OVER (ORDER BY range) / (SELECT sum(pow(range, -{0}.0)) FROM range(1, 10)) AS cdf FROM range(1, 10)),"
    f" u AS (SELECT range AS id, {_DRAW.replace('{}', '0')} AS u FROM range(1000)), drawn AS (SELECT id, least(9, count(i) FILTER (WHERE cdf < u) + 1) AS v FROM u CROSS JOIN t GROUP BY id)"
)
_RLB = "CAST(coalesce(least(max(lsn), min(lsn) FILTER (WHERE is_working)), 0) AS BIGINT)"

ORACLES: dict[str, str] = {name: _text_oracle(text) for name, (text, _) in TEXTS.items()} | {
    "join_chain3": "SELECT CAST(sum(o_orderkey) AS BIGINT) AS s0, CAST(sum(l_partkey) AS BIGINT) AS s1, CAST(sum(c_nationkey) AS BIGINT) AS s2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linenumber > 3",
    "join_broadcast": "SELECT CAST(sum(event_id) AS BIGINT) AS s0, CAST(sum(c_custkey) AS BIGINT) AS s1 FROM events JOIN customer ON user_id = c_nationkey",
    "scan_project": "SELECT l_orderkey AS c0, l_partkey AS c1 FROM lineitem",
    "filter_eq": "SELECT p_partkey AS c0, CAST(p_size AS BIGINT) AS c1 FROM part WHERE p_size = 7",
    "filter_gt": "SELECT p_partkey AS c0, CAST(p_size AS BIGINT) AS c1 FROM part WHERE p_size > 40",
    "filter_lt": "SELECT p_partkey AS c0, CAST(p_size AS BIGINT) AS c1 FROM part WHERE p_size < 5",
    "checksum_u64_wrap": "SELECT CAST(sum(((l_orderkey::HUGEINT - 9223372036854774808) + 18446744073709551616) % 18446744073709551616) % 18446744073709551616 AS VARCHAR) AS s0 FROM lineitem",
    "filter_unsigned": "SELECT count(*) AS n FROM lineitem WHERE ((l_orderkey::HUGEINT - 9223372036854774808) + 18446744073709551616) % 18446744073709551616 > 9223372036854780808",
    "filtered_cardinality": "SELECT 0 AS binding, count(*) AS n FROM orders UNION ALL SELECT 1, count(*) FROM lineitem WHERE l_linenumber > 3 UNION ALL SELECT 2, count(*) FROM customer WHERE c_nationkey < 10",
    "join_cost_rank": "WITH c AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem WHERE l_linenumber > 3) AS l, (SELECT count(*) FROM customer WHERE c_nationkey < 10) AS k), p AS (SELECT '0.0=1.0' AS predicate, o * l AS cost FROM c UNION ALL SELECT '0.1=2.0', o * k FROM c) SELECT CAST(row_number() OVER (ORDER BY cost, predicate) AS INTEGER) AS place, predicate, CAST(cost AS BIGINT) AS cost FROM p",
    "radix_histogram": "SELECT user_id % 32 AS part, count(*) AS n FROM events GROUP BY 1",
    "radix_prefix_sum": "WITH h AS (SELECT user_id % 32 AS part, count(*) AS n FROM events GROUP BY 1) SELECT part, n, CAST(coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h",
    "query_to_sql": """SELECT 'SELECT SUM("0".c1), SUM("1".c4) FROM r0 "0", r2 "1" WHERE "0".c1="1".c1 and "0".c0="1".c0 and "0".c1=5;' AS sql""",
    "query_round_trip": "SELECT '0 2|0.1=1.1&0.0=1.0&0.1<5|0.1 1.4' AS text",
    "ddl_text": "SELECT 'CREATE TABLE r6 (c0 bigint,c1 bigint,c2 bigint,c3 bigint);' || chr(10) || 'copy r6 from ''r6.tbl'' delimiter ''|'';' || chr(10) AS ddl",
    "relation_csv_lines": "SELECT c_custkey || '|' || c_nationkey || '|' AS value FROM customer",
    "relation_generated": "SELECT range AS c0, range AS c1, range AS c2 FROM range(1000)",
    "relation_binary_roundtrip": "SELECT CAST(n_nationkey AS BIGINT) AS c0, CAST(n_regionkey AS BIGINT) AS c1 FROM nation",
    "workload_batches": "SELECT 0::BIGINT AS place, (SELECT sum(o_custkey) || ' ' || sum(l_partkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 2) AS answer UNION ALL SELECT 1, (SELECT sum(l_orderkey) || ' ' || sum(l_partkey) FROM lineitem WHERE l_linenumber > 3) UNION ALL SELECT 2, 'NULL'",
    "index_point_lookup": _STATE + " SELECT key, value FROM state WHERE key = 3",
    "index_value_set": _STATE + " SELECT key, array_to_string(list_sort(list(DISTINCT value)), ',') AS values FROM state GROUP BY key",
    "index_size": _STATE + " SELECT count(*) AS size FROM state",
    "index_range_scan": _STATE + " SELECT key, value FROM state WHERE key >= 100",
    "index_full_scan": _STATE + " SELECT key, value FROM state",
    "index_reverse_scan": _STATE + " SELECT key, value FROM state",
    "index_neighbors": _STATE + " SELECT key, lag(key) OVER (ORDER BY key) AS before, lead(key) OVER (ORDER BY key) AS after FROM (SELECT DISTINCT key FROM state)",
    "index_insert": _LOG + " SELECT key, value FROM (SELECT key, value, max_by(op, seq) AS op FROM log WHERE seq % 2 = 0 GROUP BY key, value) WHERE op = 'I' UNION SELECT key, value FROM log WHERE seq % 2 = 1",
    "index_insert_unique": _LOG + ", base AS (SELECT key, value FROM (SELECT key, value, max_by(op, seq) AS op FROM log WHERE key % 2 = 0 GROUP BY key, value) WHERE op = 'I') SELECT key, value FROM base UNION ALL SELECT key, min(value) FROM log WHERE key NOT IN (SELECT key FROM base) GROUP BY key",
    "index_delete": _STATE + " SELECT key, value FROM state WHERE (key, value) NOT IN (SELECT (key, value) FROM log WHERE seq % 3 = 0)",
    "index_conditional_insert": _STATE + " SELECT key, value FROM state UNION SELECT user_id, event_id % 10 + 10 FROM events WHERE user_id NOT IN (SELECT key FROM state WHERE value >= 8)",
    "index_replay": _STATE + " SELECT key, value FROM state",
    "index_op_success": _LOG + " SELECT seq, coalesce(lag(op) OVER (PARTITION BY key, value ORDER BY seq), 'D') <> op AS ok FROM log",
    "index_replay_unique": _UNIQUE,
    "index_compact": _STATE + " SELECT key, value FROM state",
    "index_key_histogram": _STATE + " SELECT key, count(*) AS n FROM state GROUP BY key",
    "index_counters": _LOG + ", s AS (SELECT op, coalesce(lag(op) OVER (PARTITION BY key, value ORDER BY seq), 'D') <> op AS ok FROM log) SELECT count(*) FILTER (WHERE op = 'I') AS inserts, count(*) FILTER (WHERE op = 'I' AND ok) AS inserted, count(*) FILTER (WHERE op = 'D') AS deletes, count(*) FILTER (WHERE op = 'D' AND ok) AS deleted FROM s",
    "snapshot_latest": _SNAPSHOT + " GROUP BY user_id",
    "snapshot_asof": _SNAPSHOT + _MIDDLE + " GROUP BY user_id",
    "snapshot_full": f"SELECT range AS tid, coalesce(version, 0) AS version, coalesce(value, 0) AS value FROM range((SELECT max(user_id) + 1 FROM events)) LEFT JOIN ({_SNAPSHOT}{_MIDDLE} GROUP BY user_id) ON tid = range",
    "snapshot_update_counts": "SELECT user_id AS tid, count(*) AS updates FROM events GROUP BY user_id",
    "snapshot_versions": "SELECT event_id AS seq, user_id AS tid, event_id AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events",
    "snapshot_embedded": "WITH c AS (SELECT range * 100 AS cut FROM range(1, (SELECT max(event_id) // 100 + 1 FROM events))) SELECT cut, user_id AS tid, count(*) AS version, max(event_id) AS value FROM c JOIN events ON event_id < cut GROUP BY cut, user_id",
    "snapshot_text": f"SELECT 'Snapshot(' || string_agg(CAST(value AS VARCHAR), ', ' ORDER BY tid) || ')' AS text FROM ({_SNAPSHOT}{_MIDDLE} GROUP BY user_id)",
    "rlb_point": _SLOTS + f" SELECT {_RLB} AS rlb FROM slots WHERE pid <> 0",
    "rlb_timeline": _SLOTS + f", c AS (SELECT range * 100 AS cut FROM range(0, (SELECT max(event_id) // 100 + 1 FROM events))), t AS (SELECT cut, pid, max_by(is_working, seq) AS is_working, max_by(lsn, seq) AS lsn FROM c JOIN log ON seq <= cut GROUP BY cut, pid) SELECT cut, {_RLB} AS rlb FROM t GROUP BY cut",
    "rlb_flush_pointer": _SLOTS + f" SELECT range AS request, greatest(range, (SELECT {_RLB} FROM slots)) AS flush FROM range(0, 20000, 1000)",
    "rlb_active_slots": _SLOTS + " SELECT pid, is_working, lsn FROM slots WHERE pid <> 0",
    "zipf_pmf": "SELECT range AS i, round((1 / range) / (SELECT sum(1 / range) FROM range(1, 21)), 6) AS p FROM range(1, 21)",
    "zipf_cdf": "SELECT range AS i, round(sum(1 / range) OVER (ORDER BY range) / (SELECT sum(1 / range) FROM range(1, 21)), 6) AS cdf FROM range(1, 21)",
    "uniform_sample": f"SELECT range AS id, CAST(floor({_DRAW.format(0)} * 9) AS BIGINT) + 1 AS v FROM range(1000)",
    "gaussian_sample": f"SELECT range AS id, round(sqrt(-2 * ln(1 - {_DRAW.format(1)})) * cos(2 * pi() * {_DRAW.format(2)}) * 2 + 5, 6) AS v FROM range(1000)",
    "zipf_sample": _ZIPF.format(1) + " SELECT id, v FROM drawn",
    "sample_histogram": _ZIPF.format(2) + " SELECT v, count(*) AS n, repeat('*', CAST(count(*) // 10 AS INTEGER)) AS bar FROM drawn GROUP BY v",
    "stream_snapshot_latest": _SNAPSHOT + " GROUP BY user_id",
    "stream_index_replay": _STATE + " SELECT key, value FROM state",
    "stream_index_unique": _UNIQUE,
    "stream_rlb": _SLOTS + f" SELECT {_RLB} AS rlb FROM slots WHERE pid <> 0",
}
