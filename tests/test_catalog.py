import math

import duckdb
import pytest

import __spark_entry__ as entry
from rankweave.plans import catalog
from tests.conftest import SF

TABLES = "documents embeddings benchmark labels pages conversations".split()
SPARK_TO_DUCKDB = {"boolean": "BOOLEAN", "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    assert {c: SPARK_TO_DUCKDB.get(t, t) for c, t in df.dtypes} == types
    exp = sorted((tuple(_norm(x) for _, x in sorted(zip(rel.columns, r))) for r in rel.fetchall()), key=repr)
    assert got == exp


def test_every_query_has_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark).collect()
    assert [r.metric for r in out] == ["RR@10", "RR@100", "nDCG@10", "R@1000", "AP@100"]
    assert all(0.0 <= r.value <= 1.0 and not math.isnan(r.value) for r in out)
