"""Partition values in paths, and change detection on listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How hive-style paths write the null partition.
NULLS = ("__HIVE_DEFAULT_PARTITION__", "__NULL__", "")
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd-HH", "yyyyMMdd", "yyyy-MM")


def hive_value(path: Column, name: str) -> Column:
    """struct<found, value>: a k=v segment's decoded value; null for the null partition, not found for any value."""
    raw = F.regexp_extract(path, rf"(?:^|/){re.escape(name)}=([^/]*)/", 1)
    found = path.rlike(rf"(?:^|/){re.escape(name)}=[^/]*/")
    return F.struct(found.alias("found"), F.when(found & ~raw.isin(*NULLS), F.url_decode(raw)).alias("value"))


def hive_time(path: Column, name: str) -> Column:
    """The value as a time by the first format that fits; null if none does."""
    v = hive_value(path, name)["value"]
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in FORMATS]).cast("timestamp_ntz")


def template_values(path: Column, template: str) -> dict[str, Column]:
    """Named parts of a path by a template such as {yyyy}/{MM}/{dd}/{name}."""
    digits = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}"}
    names = re.findall(r"\{(\w+)\}", template)
    pattern = "".join(f"({digits.get(x[1:-1], '[^/]+')})" if x.startswith("{") else re.escape(x) for x in re.split(r"(\{\w+\})", template))
    return {n: F.regexp_extract(path, pattern, i + 1) for i, n in enumerate(names)}


def template_time(path: Column, template: str) -> Column:
    """The time that a template's date parts make; month and day are 1 where it has none."""
    parts = template_values(path, template)
    n = lambda k, d: F.coalesce(F.try_to_number(parts[k], F.lit("9999")).cast("int"), F.lit(d)) if k in parts else F.lit(d)
    return F.when(parts["yyyy"] != "", F.make_timestamp_ntz(n("yyyy", 1), n("MM", 1), n("dd", 1), n("HH", 0), F.lit(0), F.lit(0)))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of the data files below a folder, hidden ones left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{parquet,pq}").load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def touched(files: DataFrame, since: DataFrame) -> DataFrame:
    """Files that are new or other than in an earlier listing; a file without a time always counts."""
    had = since.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m"))
    return files.join(had, "path", "left").where(F.col("modified").isNull() | ~(F.col("size").eqNullSafe(F.col("_s")) & F.col("modified").eqNullSafe(F.col("_m")))).drop("_s", "_m")
