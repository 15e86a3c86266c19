"""Revisions, inherited roles, measures taken while writing, and restatements on a stream."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import govern as v
from tidemark.plans import history, measures
from tidemark.streaming import events

EDGE = "src string, dst string, value string"


def test_revisions(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    make = lambda *rows: spark.createDataFrame(list(rows), EDGE)
    one = make(("a", "b", "same"), ("b", "c", "day"))
    two = make(("a", "b", "any"), ("c", "d", "day"))
    assert history.head(spark, path) is None and history.graph(spark, path).count() == 0
    first = history.record(spark, path, one, "2024-01-01 00:00:00", "ann")
    assert (first["number"], first["added"], first["parent"]) == (0, 2, None)
    assert history.record(spark, path, one.orderBy(F.desc("src")), "2024-01-02 00:00:00")["number"] == 0  # nothing new
    with pytest.raises(history.StaleParent):
        history.record(spark, path, two, "2024-01-02 00:00:00")
    with pytest.raises(history.StaleParent):
        history.record(spark, path, two, "2024-01-02 00:00:00", parent=history.digest(two))
    second = history.record(spark, path, two, "2024-01-03 00:00:00", parent=first["digest"])
    assert (second["number"], second["added"], second["removed"], second["changed"]) == (1, 1, 1, 1)
    third = history.record(spark, path, one, "2024-01-05 00:00:00", parent=second["digest"])
    assert third["digest"] == first["digest"]
    at = spark.sql("SELECT explode(array(timestamp'2023-01-01', timestamp'2024-01-01', timestamp'2024-01-04', timestamp'2025-01-01')) AS at")
    got = {}
    for r in history.as_of(spark, path, at).collect():
        got.setdefault(r["at"].strftime("%Y-%m-%d"), set()).add((r["src"], r["dst"], r["value"]))
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert got == {"2024-01-01": rows(one), "2024-01-04": rows(two), "2025-01-01": rows(one)}
    assert [tuple(r) for r in history.unsafe(spark, path).orderBy("number").collect()] == [(1, 1, 1), (2, 1, 1)]


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/h"
    first = history.record(spark, path, spark.createDataFrame([("a", "b", "x")], EDGE), "2024-01-01 00:00:00")
    gate, put, done = threading.Barrier(2), history._put_if_absent, []
    monkeypatch.setattr(history, "_put_if_absent", lambda *a: (gate.wait(60), put(*a))[1])

    def write(name):
        try:
            done.append(history.record(spark, path, spark.createDataFrame([("a", name, "x")], EDGE), "2024-01-02 00:00:00", name, parent=first["digest"])["author"])
        except history.StaleParent:
            done.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in ("p", "q")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner = next(x for x in done if x)
    assert sorted(map(str, done)) == sorted(["None", winner])
    assert [tuple(r) for r in history.graph(spark, path).collect()] == [("a", winner, "x")]


def test_roles_inherit_and_rings_end(spark):
    members = spark.createDataFrame([("p", "x"), ("q", "z"), ("r", "alone")], "principal string, role string")
    inherits = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("z", "base"), ("alone", "missing")], "role string, parent string")
    grants = spark.createDataFrame([("base", "read"), ("y", "write"), ("other", "drop")], "role string, action string")
    got = {(r["principal"], r["carried"], r["action"]) for r in v.inherited_grants(members, inherits, grants).collect()}
    assert got == {(p, c, a) for p in "pq" for c, a in (("base", "read"), ("y", "write"))}


def test_measures_equal_a_second_scan(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("id") / 2))
    m = measures.Measures({"rows": F.lit(1), "x": F.col("x")}, {"most": F.col("id")}, {"x": (F.col("x"), [5.0, 50.0])})
    got = {(r["name"], r["kind"], r["bucket"]): r["value"] for r in measures.write(df, f"file://{tmp_path}/out", m).collect()}
    back = spark.read.parquet(f"file://{tmp_path}/out")
    again = dict(zip([c for c in back.agg(*m.columns()).columns], back.agg(*m.columns()).first(), strict=True))
    assert got == {(n, k, b): x for n, k, b, x in measures.rows(again)}
    assert got["rows", "counter", None] == 1000 and got["x", "histogram", 5.0] == back.where("x <= 5").count()
    assert [r["value"] for r in measures.write(df.where("false"), f"file://{tmp_path}/none", m).where("kind = 'counter'").collect()] == [None, None]


def test_measures_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    listener = measures.StreamMeasures("s")
    spark.streams.addListener(listener)
    try:
        m = measures.Measures({"rows": F.lit(1)}, {"most": F.col("id")}, {"id": (F.col("id"), [9.0, 14.0])})
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", "1").parquet(f"file://{tmp_path}/in/*").observe("s", *m.columns())
        stream.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
        for _ in range(100):
            if len(listener.batches) == 3:
                break
            threading.Event().wait(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = {(r["name"], r["kind"], r["bucket"]): r["value"] for r in listener.read(spark).collect()}
    assert got["rows", "counter", None] == 30 and got["most", "gauge", None] == 29
    assert (got["id", "histogram", 9.0], got["id", "histogram", 14.0], got["id", "histogram", float("inf")]) == (10, 15, 30)


def test_restatements_on_a_stream_equal_those_of_a_batch(spark, tmp_path):
    hour = 3600
    arrivals = [("a", "x", 0), ("a", "y", 50 * 60), ("a", "z", 70 * 60), ("b", "x", 0), ("b", "x", hour), ("c", None, 10), ("c", None, 20), ("d", "x", 0), ("e", "p", 30), ("e", "q", 59 * 60), ("e", "p", 61 * 60)]
    rows = spark.createDataFrame([(k, d, 1_700_000_000 + s) for k, d, s in arrivals], "k string, d string, s long").withColumn("ts", F.timestamp_seconds("s"))
    batch = {r["key"]: (r["n"], r["versions"]) for r in events.restatements(rows, "ts", "k", "d", "2 hours").collect()}
    assert batch == {"a": (3, 3), "c": (2, 1), "e": (3, 2)}
    for i, cut in enumerate(("s < 1700000100", "s between 1700000100 and 1700003600", "s > 1700003600")):  # across windows' edges
        rows.where(cut).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"file://{tmp_path}/in/*")
    q = events.restatements(stream, "ts", "k", "d", "2 hours").writeStream.outputMode("update").format("memory").queryName("restated").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    last = {r["key"]: (r["n"], r["versions"]) for r in spark.table("restated").groupBy("key").agg(F.max("n").alias("n"), F.max("versions").alias("versions")).collect()}
    assert last == batch
