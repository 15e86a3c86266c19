"""Invalidation and rebuilds end to end on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.time import truncate
from tidemark.operators import graph as g
from tidemark.plans import rebuild
from tidemark.plans.invalidate import edges, images, invalidate, key, shown
from tidemark.plans.lattice import ANYTHING, same, trailing, window


def keys(spark, rows):
    df = spark.createDataFrame(rows, "ds string, dt string, region string, any boolean")
    return df.select("ds", F.when(F.col("any"), key(dt=F.col("dt"), region=None)).otherwise(key(dt=F.col("dt"), region=F.col("region"))).alias("key"))


def shown_plan(plan):
    return sorted((r["ds"], r["k"]) for r in plan.select("ds", shown(F.col("key")).alias("k")).collect())


HOPS = [
    ("raw", "silver", {"dt": window("dt", "day"), "region": same("region")}),
    ("silver", "gold", {"dt": window("dt", "month", fine="day"), "region": same("region")}),
    ("silver", "all", {"dt": ANYTHING}),
]


def test_one_day_makes_one_month_stale(spark):
    plan = invalidate(keys(spark, [("raw", "2026-03-14 00:00:00", "eu", False)]), edges(spark, HOPS))
    assert shown_plan(plan) == [("all", "dt=*"), ("gold", "dt=2026-03-01 00:00:00,region=eu"), ("raw", "dt=2026-03-14 00:00:00,region=eu"), ("silver", "dt=2026-03-14 00:00:00,region=eu")]


def test_null_partition_is_not_any(spark):
    plan = invalidate(keys(spark, [("raw", "2026-03-14 00:00:00", None, False), ("raw", "2026-03-14 00:00:00", "us", True)]), edges(spark, HOPS))
    got = shown_plan(plan)
    assert ("silver", "dt=2026-03-14 00:00:00,region=*") in got
    assert ("silver", "dt=2026-03-14 00:00:00,region=NULL") not in got, "a wider key takes the narrower in"
    alone = shown_plan(invalidate(keys(spark, [("raw", "2026-03-14 00:00:00", None, False)]), edges(spark, HOPS)))
    assert ("silver", "dt=2026-03-14 00:00:00,region=NULL") in alone


def test_cycle_ends_wide(spark):
    ring = [("a", "b", {"dt": trailing("dt", 2, "day")}), ("b", "a", {"dt": trailing("dt", 2, "day")})]
    dirty = spark.range(1).select(F.lit("a").alias("ds"), key(dt=F.lit("2026-01-01 00:00:00")).alias("key"))
    got = shown_plan(invalidate(dirty, edges(spark, ring[:1])))
    assert len(got) == 3
    import tidemark.plans.invalidate as module

    module.CYCLE_ROUNDS, before = 3, module.CYCLE_ROUNDS
    try:
        assert ("a", "dt=*") in shown_plan(invalidate(dirty, edges(spark, ring)))
    finally:
        module.CYCLE_ROUNDS = before


def test_too_many_keys_widen(spark):
    hop = edges(spark, [("a", "b", {"x": trailing("x", 100, "day"), "y": trailing("y", 10, "day")})])
    row = hop.select(images(F.col("fields"), key(x=F.lit("2026-01-01 00:00:00"), y=F.lit("2026-01-01 00:00:00")), 500).alias("i")).first()
    assert len(row["i"]) == 10
    assert all(k[0]["any"] and not k[1]["any"] for k in row["i"])


@pytest.fixture()
def lake(spark, tmp_path):
    rows = [("2026-03-14", "eu", 1), ("2026-03-14", "us", 2), ("2026-03-15", "eu", 3), ("2026-04-01", "eu", 4), ("2026-04-02", "us", 5)]
    raw = spark.createDataFrame(rows, "dt string, region string, amount long").withColumn("dt", F.col("dt").cast("timestamp_ntz"))
    return raw, str(tmp_path / "gold")


def gold(raw):
    return raw.groupBy(F.date_format(truncate("dt", "month"), "yyyy-MM-dd").alias("m"), "region").agg(F.sum("amount").alias("revenue"))


def marks(df):
    return {(r["m"], r["region"]): r["fp"] for r in rebuild.fingerprints(df, ["m", "region"], ["revenue"]).collect()}


def test_incremental_equals_full_and_drops_emptied(spark, lake):
    raw, path = lake
    gold(raw).write.partitionBy("m", "region").parquet(path)
    before = marks(spark.read.parquet(path).withColumn("m", F.date_format("m", "yyyy-MM-dd")))
    late = raw.where("not (region = 'us' and dt >= '2026-04-01')").unionByName(raw.limit(1).withColumn("amount", F.lit(99).cast("long")))
    planned = spark.createDataFrame([("2026-03-01", "eu"), ("2026-04-01", "us")], "m string, region string")
    new = gold(late).join(planned, ["m", "region"], "left_semi")
    empty = rebuild.overwrite_partitions(new, planned, path, ["m", "region"])
    assert empty == [{"m": "2026-04-01", "region": "us"}]
    assert not os.path.exists(f"{path}/m=2026-04-01/region=us")
    after = marks(spark.read.parquet(path).withColumn("m", F.date_format("m", "yyyy-MM-dd")))
    assert after == marks(gold(late))
    changed = {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    assert changed == {("2026-03-01", "eu"), ("2026-04-01", "us")}


def test_predicate_is_half_open_and_pushed(spark, lake, tmp_path):
    raw, _ = lake
    got = raw.where(rebuild.predicate([{"dt": "2026-03-01 00:00:00", "region": "eu"}], {"dt": "month"})).agg(F.sum("amount")).first()[0]
    assert got == 4
    assert raw.where(rebuild.predicate([], {})).count() == 5
    assert raw.where(rebuild.predicate([{}], {})).count() == 5
    raw.write.parquet(str(tmp_path / "raw"))
    plan = spark.read.parquet(str(tmp_path / "raw")).where(rebuild.predicate([{"region": "eu"}], {}))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(region), EqualTo(region,eu)]" in plan


def test_erase_refuses_unknown_columns(spark, lake):
    raw, _ = lake
    with pytest.raises(ValueError):
        rebuild.erase(raw, "user", 1)
    stays, goes = rebuild.erase(raw, "region", "eu", F.col("amount") > 1)
    assert (stays.count(), goes.count()) == (3, 2)


def test_graph_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    assert {r["node"] for r in g.cyclic_nodes(e).collect()} == {1, 2, 3, 5}
    assert {(r["node"], r["component"]) for r in g.strong_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5)}
    assert g.levels(e).count() == 0
    none = e.where("false")
    assert g.weak_components(none).count() == 0 and g.roots(none).count() == 0
    assert g.shortest_path(e, 1, 4).first()["path"] == [1, 2, 3, 4]
    assert g.shortest_path(e, 4, 1).count() == 0
