"""Logs, statements, footers, streams and renderings."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import render
from tidemark.sources import delta, footers, lineage, paths
from tidemark.streaming import events as stream


def test_delta_log(spark, tmp_path):
    log = tmp_path / "t" / "_delta_log"
    log.mkdir(parents=True)

    def file(path, dt, **more):
        return {"path": path, "partitionValues": {"dt": dt}, "size": 1, "modificationTime": 0, "dataChange": True, **more}

    commits = [
        [{"metaData": {"schemaString": "{}", "partitionColumns": ["dt"]}}, {"add": file("a", "1")}, {"add": file("b", "2")}],
        [{"remove": file("a", "1")}, {"add": file("c", "3")}],
        [{"remove": file("b", "2", dataChange=False)}, {"add": file("d", "2", dataChange=False)}],
    ]
    for v, actions in enumerate(commits):
        (log / f"{v:020d}.json").write_text("\n".join(map(json.dumps, actions)))
    rows = delta.read_log(spark, f"file://{tmp_path}/t")
    assert delta.partition_columns(spark, f"file://{tmp_path}/t") == ["dt"]
    assert {r["path"] for r in delta.live_files(rows).collect()} == {"c", "d"}
    assert {json.loads(r["partition"])[0]["value"] for r in delta.changed_partitions(rows, 0).collect()} == {"1", "3"}
    assert delta.changed_partitions(rows, 1).count() == 0


def test_run_events_skip_torn_lines(spark, tmp_path):
    good = {"eventType": "COMPLETE", "eventTime": "1", "run": {"runId": "r"}, "job": {"namespace": "n", "name": "j"}, "inputs": [{"namespace": "a", "name": "x"}], "outputs": [{"namespace": "a", "name": "y"}]}
    (tmp_path / "e.json").write_text(json.dumps(good) + "\n" + json.dumps(good)[:40])
    runs = lineage.collapse_runs(lineage.read_run_events(spark, f"file://{tmp_path}/e.json"))
    assert [(r["src"], r["dst"]) for r in lineage.run_edges(runs).collect()] == [("a/x", "a/y")]


def test_footers_match_scan(spark):
    files = spark.read.parquet(f"{DATA}/customer.parquet").select(F.col("_metadata.file_path").alias("path")).distinct()
    got = {r["name"]: r["row_count"] for r in footers.footer_profile(files).collect()}
    assert got["c_custkey"] == spark.read.parquet(f"{DATA}/customer.parquet").count()


def test_listing(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/x")
    files = paths.listing(spark, f"file://{tmp_path}/x")
    assert files.count() == 1
    assert paths.touched(files, files).count() == 0


@pytest.mark.parametrize(("raw", "found", "value"), [("t/region=eu/f", True, "eu"), ("t/region=a%20b/f", True, "a b"), ("t/region=__NULL__/f", True, None), ("t/f", False, None)])
def test_hive_values(spark, raw, found, value):
    r = spark.range(1).select(paths.hive_value(F.lit(raw), "region").alias("v")).first()["v"]
    assert (r["found"], r["value"]) == (found, value)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"file://{tmp_path}/e")
    source = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e")
    query = stream.rollup(source, "ts", "1 day", ["event_type"], "1 hour").writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    batch = stream.rollup(events, "ts", "1 day", ["event_type"], "1 hour")
    assert sorted(map(str, spark.table("rolled").collect())) == sorted(map(str, batch.collect()))


def test_stream_drops_replays(spark, tmp_path):
    twice = spark.createDataFrame([("k", "d", 1), ("k", "d", 2), ("k", "e", 3)], "k string, d string, s long").withColumn("ts", F.timestamp_seconds("s"))
    twice.write.parquet(f"file://{tmp_path}/a")
    source = spark.readStream.schema(twice.schema).parquet(f"file://{tmp_path}/a")
    query = stream.without_replays(source, "ts", ["k", "d"], "1 hour").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert spark.table("once").count() == 2


def test_quiet_window_counts_from_what_was_sent(spark):
    rows = spark.createDataFrame([("a", s) for s in (0, 50, 90, 110, 190, 220)], "f string, s long").withColumn("at", F.timestamp_seconds("s"))
    assert sorted(r["sent"] for r in stream.quiet_alerts(rows, "f", "at", 100).collect()) == [0, 110, 220]


def test_renderings(spark):
    e = spark.createDataFrame([("a", "b"), ("b", 'c"x')], "src string, dst string")
    assert render.mermaid(e).startswith("flowchart LR") and '"a" -> "b"' in render.dot(e)
    assert len(json.loads(render.cytoscape(e))["elements"]["nodes"]) == 3
    assert render.markdown(e).count("\n") == 3
    assert json.loads(render.open_lineage(e, "j")[0])["outputs"][0]["name"] == "b"
    compile(render.airflow_dag([["a"], ["b"]], "d"), "dag", "exec")
    assert 'rows{src="a"} 1' in render.prometheus(e.groupBy("src").count(), "rows", "count")
