"""Each query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from sluice import registry

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())
