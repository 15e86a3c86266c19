"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every tidemark session starts with; a cluster's own values win where it sets them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword settings use `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only a local-mode session that names none gets a folder of its own; a
    cluster session without the setting is refused, since a machine-local
    folder would lose files with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Rows that pass between Spark and a Python worker at a time: whole texts are large.
ROWS_PER_BATCH = 1000


def ship(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from wherever it was loaded, and take small batches.

    A cluster gets the package with --py-files or an installation.
    """
    home = str(Path(__file__).resolve().parent.parent)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    env = spark.sparkContext.environment
    if home not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])


def materialize(df: DataFrame, label: str, zstd: int = 0) -> DataFrame:
    """Write `df` as Parquet in the shared folder, at that Zstandard level if any, and read it back.

    Cuts the lineage: a lost executor costs the tasks that read the files,
    never the work that made them. Pruning and filters reach the new scan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    how = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(zstd)} if zstd else {}
    df.write.options(**how).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which Spark may choose to broadcast a written table: it weighs compressed files, and a broadcast may hold fifty times as much.
FEW_ROWS = 200_000


def many(df: DataFrame) -> bool:
    """Whether a written table has too many rows for a broadcast; its footers tell."""
    return df.count() > FEW_ROWS


def shuffled(df: DataFrame, yes: bool = True) -> DataFrame:
    """The side of a join that is hashed after a shuffle, so that neither side passes through the driver; nothing is sorted."""
    return df.hint("shuffle_hash") if yes else df


class Growing:
    """A table in the shared folder that parts are appended to, so that a loop never rewrites what it has found."""

    def __init__(self, first: DataFrame, label: str):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path = f"{shared_dir(self.spark)}/tidemark/{label}-{uuid.uuid4().hex}"
        self.parts = 0
        self.append(first)

    def append(self, df: DataFrame) -> DataFrame:
        """The part as written."""
        path = f"{self.path}/part={self.parts}"
        df.select(*self.schema.names).write.parquet(path)
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/part={i}" for i in range(self.parts)])
