"""Specs, keys, names, selectors and manifests."""

import json
from datetime import datetime

import pytest

from tidemark.operators.selectors import Term, select
from tidemark.plans.naming import Field, asset, parse_key, parse_ref, parse_spec
from tidemark.sources import dbt


def test_specs_and_keys():
    spec = parse_spec("dt:daily, region")
    assert spec == (Field("dt", "day"), Field("region"))
    assert parse_key("dt=2026-03-14T15:09:26,region=eu", spec) == {"dt": datetime(2026, 3, 14), "region": "eu"}
    assert parse_key("dt=2026-03-14T23:30:00-02:00", spec) == {"dt": datetime(2026, 3, 15)}
    assert parse_key("dt=*", spec) == {}
    for grain, want in (("hour", datetime(2026, 3, 14, 15)), ("month", datetime(2026, 3, 1)), ("year", datetime(2026, 1, 1))):
        assert parse_key("t=2026-03-14T15:09:26", parse_spec(f"t:{grain}"))["t"] == want
    for bad in ("dt:week", "a,a", ":day"):
        with pytest.raises(ValueError):
            parse_spec(bad)
    with pytest.raises(ValueError):
        parse_key("x=1", spec)


def test_assets():
    assert asset("vector_index", "docs", "Prod") == "vector-index://prod/docs"
    assert parse_ref("model://r/m@v2") == ("model://r/m", "v2") and parse_ref("s3://a@b/c") == ("s3://a@b/c", None)


def test_selectors(spark):
    e = spark.createDataFrame([("raw/a", "silver/b"), ("silver/b", "gold/c"), ("raw/z", "gold/c"), ("gold/c", "gold/d")], "src string, dst string")
    got = lambda text, **k: sorted(r["node"] for r in select(text, e, **k).collect())
    assert got("gold/*") == ["gold/c", "gold/d"]
    assert got("1+gold/c") == ["gold/c", "raw/z", "silver/b"]
    assert got("+gold/c+") == ["gold/c", "gold/d", "raw/a", "raw/z", "silver/b"]
    assert got("@silver/b") == ["gold/c", "gold/d", "raw/a", "raw/z", "silver/b"]
    assert got("raw/a+,ns:gold raw/z") == ["gold/c", "gold/d", "raw/z"]
    assert got("label:pii", labels=spark.createDataFrame([("raw/a", "pii")], "node string, label string")) == ["raw/a"]
    assert Term.parse("ilver") == Term("*ilver*", "full")
    with pytest.raises(ValueError):
        select(" ", e)


def test_manifest(spark, tmp_path):
    node = lambda kind, name, deps=(), **config: {"resource_type": kind, "database": "db", "schema": "s", "name": name, "depends_on": {"nodes": list(deps)}, "config": config}
    doc = {"metadata": {"adapter_type": "snowflake"}, "sources": {"source.x": node("source", "raw")}, "nodes": {"model.y": node("model", "y", ["source.x"], partition_by={"field": "dt", "granularity": "DAY"}), "test.t": node("test", "t", ["model.y"])}}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(doc))
    for given in (json.dumps(doc), f"file://{path}"):
        tables = dbt.manifest(spark, given)
        assert {(r["ds"], r["field"], r["grain"]) for r in tables.collect()} == {("snowflake/db.s.raw", None, None), ("snowflake/db.s.y", "dt", "day")}
        assert [(r["src"], r["dst"]) for r in dbt.edges(tables).collect()] == [("snowflake/db.s.raw", "snowflake/db.s.y")]
