"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tests.conftest import DATA
from tidemark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def shown(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else repr(round(x, 9)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rel = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES[k] for c, k in df.dtypes} == types
    ours = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=str)
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(shown(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert ours == theirs


def test_all_have_sql():
    assert not set(QUERIES) - set(SQL)


def test_minhash_recall(spark):
    """Every pair of exact Jaccard 0.8 and more is in one cluster."""
    pairs = QUERIES["exact_jaccard_pairs"](spark, DATA).collect()
    cluster = {r["node"]: r["component"] for r in QUERIES["minhash_clusters"](spark, DATA).collect()}
    assert pairs
    found = sum(cluster.get(p["a"]) is not None and cluster.get(p["a"]) == cluster.get(p["b"]) for p in pairs)
    assert found >= 0.9 * len(pairs)
