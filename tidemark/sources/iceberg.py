"""Iceberg metadata: snapshots of metadata files, manifest entries as the catalog's own table gives them, and partition values.

Manifests are Avro, for which no reader is installed here: entries come as a
DataFrame (a catalog's `entries` table, or manifests read with spark-avro).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SCHEMA = "snapshots array<struct<`snapshot-id`:bigint,`timestamp-ms`:bigint,`manifest-list`:string>>, `current-snapshot-id` bigint"


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, timestamp_ms) of a metadata file."""
    rows = spark.read.schema(_SCHEMA).json(path, multiLine=True).select(F.explode("snapshots").alias("s"))
    return rows.select(F.col("s.snapshot-id").alias("snapshot_id"), F.col("s.timestamp-ms").alias("timestamp_ms"))


def changed(snaps: DataFrame, entries: DataFrame, since: int | None) -> DataFrame:
    """(partition, complete) touched after a snapshot, deletes included; entries: snapshot_id, partition.

    Entries belong to the snapshot that made them, so those carried forward do
    not count again. If the token's snapshot has expired, all that is known is
    reported, as not complete.
    """
    order = snaps.select("snapshot_id", F.row_number().over(W.orderBy("timestamp_ms", "snapshot_id")).alias("n"))  # a table has few snapshots
    after = order.agg(F.max(F.when(F.col("snapshot_id") == F.lit(since), F.col("n"))).alias("after"))
    later = order.crossJoin(after).where(F.coalesce(F.col("n") > F.col("after"), F.lit(True)))  # one row
    complete = F.lit(True) if since is None else F.col("after").isNotNull()
    return entries.join(later, "snapshot_id").select("partition", complete.alias("complete")).distinct()


def partition_time(value: Column, transform: str) -> Column:
    """The start of the bucket that an offset since 1970 names, by transform year, month, day or hour; null stays null."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    n = value.cast("int")
    part = {"year": {"years": n}, "month": {"months": n}, "day": {"days": n}, "hour": {"hours": n}}[transform]
    return (epoch + F.make_interval(**part)).cast("timestamp_ntz")
