"""Delta transaction logs read as JSON commits and Parquet checkpoints; no table format library is needed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_FILE = "struct<path:string,partitionValues:map<string,string>,size:bigint,modificationTime:bigint,dataChange:boolean>"
SCHEMA = f"add {_FILE}, remove {_FILE}, metaData struct<schemaString:string,partitionColumns:array<string>>"


_COMMIT = re.compile(r"(\d{20})\.json")
_CHECKPOINT = re.compile(r"(\d{20})\.checkpoint(?:\.\d{10}\.(\d{10}))?\.parquet")


def _files(spark: SparkSession, table: str) -> list[str]:
    """Paths in the log's folder, of which a table keeps few."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/_delta_log")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(x.getPath()) for x in fs.listStatus(folder))


def _actions(raw: DataFrame) -> DataFrame:
    """(version, action, path, values, change) of add and remove actions."""
    one = lambda a: raw.where(F.col(a).isNotNull()).select("version", F.lit(a).alias("action"), f"{a}.path", F.col(f"{a}.partitionValues").alias("values"), F.coalesce(f"{a}.dataChange", F.lit(True)).alias("change"))
    return one("add").unionByName(one("remove"))


def read_log(spark: SparkSession, table: str) -> DataFrame:
    """(version, action, path, values, change) of the newest whole checkpoint and every commit after it; without one, of every commit."""
    files = _files(spark, table)
    found: dict[int, list[str]] = {}
    parts: dict[int, int] = {}
    for path in files:
        if m := _CHECKPOINT.fullmatch(path.rpartition("/")[2]):
            found.setdefault(int(m[1]), []).append(path)
            parts[int(m[1])] = int(m[2] or 1)
    whole = [v for v, paths in found.items() if len(paths) == parts[v]]
    start = max(whole, default=-1)
    commits = [path for path in files if (m := _COMMIT.fullmatch(path.rpartition("/")[2])) and int(m[1]) > start]
    out = None
    if commits:
        out = _actions(spark.read.schema(SCHEMA).json(commits).withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), r"(\d{20})\.json$", 1).cast("long")))
    if whole:
        kept = _actions(spark.read.schema(SCHEMA).parquet(*found[start]).withColumn("version", F.lit(start).cast("long")))
        out = kept if out is None else kept.unionByName(out)
    return out if out is not None else spark.createDataFrame([], "version long, action string, path string, values map<string,string>, change boolean")


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    """Columns of the newest metadata action."""
    raw = spark.read.schema(SCHEMA).json(f"{table}/_delta_log/*.json").where("metaData is not null")
    row = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{20})\.json$", 1).alias("v"), "metaData.partitionColumns").orderBy(F.desc("v")).first()
    return list(row["partitionColumns"] or []) if row else []


def live_files(log: DataFrame) -> DataFrame:
    """(path): files whose last action is an add."""
    w = W.partitionBy("path").orderBy(F.desc("version"), F.asc("action"))
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1 and action = 'add'").select("path")


def changed_partitions(log: DataFrame, after: int) -> DataFrame:
    """(values): partitions with data changes after a version; compaction does not count."""
    entries = F.array_sort(F.map_entries("values"))
    return log.where((F.col("version") > after) & F.col("change")).select(F.to_json(entries).alias("partition")).distinct()
