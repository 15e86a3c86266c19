"""Sources by name: rows, filters that reach them, and streams that are stopped and started again."""

import os

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.sources import delta, registered
from tidemark.suites import feeds


def test_listing(spark, tmp_path):
    registered.register(spark)
    assert registered.registered() == ["tidemark_delta", "tidemark_delta_pruned", "tidemark_listing", "tidemark_listing_pruned"]
    root = f"file://{tmp_path}/t"
    spark.range(40).withColumn("k", F.col("id") % 4).repartition("k").write.partitionBy("k").parquet(root)
    spark.range(3).coalesce(1).write.mode("append").parquet(root)
    load = lambda at=root: spark.read.format("tidemark_listing_pruned").load(at)
    files = spark.read.format("tidemark_listing").load(root)
    rows = files.collect()
    assert len(rows) == 5 and {r["partition"].get("k") for r in rows} == {None, "0", "1", "2", "3"}
    assert all(os.path.getsize(r["path"]) == r["size"] and r["etag"].startswith(r["path"]) for r in rows)
    assert files.where(F.col("partition")["k"] == "2").count() == 1 and files.count() == 5  # used again
    one = load().where(F.col("path").startswith(f"{tmp_path}/t/k=2")).where("size > 0")
    assert one.count() == 1 and one.rdd.getNumPartitions() == 2  # the root itself and one folder of four
    newest = load().agg(F.max("modified")).first()[0]
    assert load().where(F.col("modified") > F.lit(newest)).count() == 0
    assert load().where(F.col("modified") >= F.lit(newest)).count() == sum(r["modified"] == newest for r in rows)
    assert load(f"file://{tmp_path}/none").count() == 0


def test_delta_log(spark):
    registered.register(spark)
    root = feeds.delta_table(spark, DATA)
    log = spark.read.format("tidemark_delta").load(root)
    assert sorted(map(str, log.collect())) == sorted(map(str, delta.read_log(spark, root).select(*log.columns).collect()))
    late = spark.read.format("tidemark_delta_pruned").load(root).where("version > 1 and action = 'remove'")
    assert [(r["version"], r["path"]) for r in late.collect()] == [(3, "f5")]
    assert late.rdd.getNumPartitions() == 2  # commits 2 and 3, not the checkpoint
    assert spark.read.format("tidemark_delta").load(f"{root}/none").count() == 0


def test_a_stream_sees_each_file_once(spark, tmp_path):
    registered.register(spark)
    root = f"{tmp_path}/in"
    os.makedirs(f"{root}/k=1")
    second = 1_700_000_000

    def put(name, at):
        spark.range(1).toPandas().to_parquet(f"{root}/{name}")
        os.utime(f"{root}/{name}", (at, at))

    def run():
        """One start, stopped when it has caught up."""
        q = spark.readStream.format("tidemark_listing").load(root).select("path", "etag").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").option("path", f"file://{tmp_path}/out").start()
        q.processAllAvailable()
        q.stop()

    put("a.parquet", second)
    put("k=1/b.parquet", second)
    run()
    put("c.parquet", second)  # of the same second as the token
    put("k=1/d.parquet", second + 1)
    run()
    run()
    put("a.parquet", second + 2)  # a new version of a file
    run()
    seen = [r["path"].rpartition("in/")[2] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()]
    assert sorted(seen) == ["a.parquet", "a.parquet", "c.parquet", "k=1/b.parquet", "k=1/d.parquet"]


def test_a_killed_stream_repeats_its_batch_and_no_other(spark, tmp_path):
    """A batch whose sink failed is read again between the same tokens, whatever has come meanwhile."""
    registered.register(spark)
    root, seen = f"{tmp_path}/in", []
    os.makedirs(root)

    def put(name, at):
        spark.range(1).toPandas().to_parquet(f"{root}/{name}")
        os.utime(f"{root}/{name}", (at, at))

    def run(fail):
        def sink(df, number):
            rows = sorted(r["path"].rpartition("/")[2] for r in df.collect())
            if fail:
                raise RuntimeError("killed")
            seen.append((number, rows))

        q = spark.readStream.format("tidemark_listing").load(root).writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        except Exception:  # noqa: BLE001 - the failure is the test
            assert fail
        q.stop()

    put("a.parquet", 1_700_000_000)
    run(fail=True)
    put("b.parquet", 1_700_000_000)
    put("c.parquet", 1_700_000_005)
    run(fail=False)
    assert seen[0] == (0, ["a.parquet"])
    assert [x for _, rows in seen for x in rows] == ["a.parquet", "b.parquet", "c.parquet"]
