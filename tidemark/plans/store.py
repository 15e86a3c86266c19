"""State kept between runs as Parquet: merged graphs, appended events, dumps and erased files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def merge(old: DataFrame, new: DataFrame, keys: list[str], regenerated: tuple[str, ...] = (), evidence: str = "evidence") -> DataFrame:
    """Old rows under new ones by key, the new ones winning.

    Evidence that starts with a regenerated prefix was read anew as a whole, so
    what the new rows do not repeat of it goes; all other old rows stay.
    """
    stays = old
    for prefix in regenerated:
        stays = stays.where(~F.coalesce((F.col(evidence) == prefix.rstrip(":")) | F.col(evidence).startswith(prefix), F.lit(False)))
    return stays.join(new.select(*keys), keys, "left_anti").unionByName(new)


def append(events: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Events are added, never changed."""
    writer = events.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as lines of JSON with its schema beside it."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}/rows")
        df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/schema")


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A dumped table."""
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/{name}/schema").first()["value"]))
    return spark.read.schema(schema).json(f"{path}/{name}/rows")


def rebuild_all(model: DataFrame, path: str, by: list[str]) -> None:
    """A whole table built anew over what was there."""
    model.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def erase_files(spark: SparkSession, paths: list[str]) -> int:
    """Delete listed objects; how many were there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(conf).delete(p, False))
    return gone
