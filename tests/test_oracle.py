"""Each query against its SQL, on the same tables."""

import math
import os

import duckdb
import pytest

from sigmill import catalogue

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return repr(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    rel = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want) > 0
    a, b = rows_of(df.columns, got), rows_of(names, want)
    assert a == b, [(x, y) for x, y in zip(a, b) if x != y][:3]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
