"""Tables, specs and lineage of a dbt manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import GRAINS

KINDS = ("model", "source", "snapshot", "seed")
_CONFIG = "struct<materialized:string,partition_by:struct<field:string,granularity:string,data_type:string>>"
_NODE = f"struct<resource_type:string,database:string,schema:string,name:string,alias:string,identifier:string,depends_on:struct<nodes:array<string>>,config:{_CONFIG},compiled_code:string>"
SCHEMA = f"metadata struct<adapter_type:string,project_name:string>, sources map<string,{_NODE}>, nodes map<string,{_NODE}>"


def manifest(spark: SparkSession, text_or_path: str) -> DataFrame:
    """The tables of one manifest, given as a path or as its text."""
    if text_or_path.lstrip().startswith("{"):
        return manifests(spark.createDataFrame([(json.dumps(json.loads(text_or_path)),)], "value string"))
    return _tables(spark.read.schema(SCHEMA).json(text_or_path, multiLine=True))


def manifests(texts: DataFrame, text: str = "value") -> DataFrame:
    """The tables of many manifests, one in each row."""
    return _tables(texts.select(F.from_json(text, SCHEMA).alias("m")).select("m.*"))


def _tables(raw: DataFrame) -> DataFrame:
    """(project, uid, ds, kind, depends_on, field, grain, sql) of every table; tests and other nodes are passed over."""
    every = F.map_concat(F.coalesce("sources", F.create_map().cast(f"map<string,{_NODE}>")), F.coalesce("nodes", F.create_map().cast(f"map<string,{_NODE}>")))
    rows = raw.select("metadata", F.explode(every).alias("uid", "n")).where(F.col("n.resource_type").isin(*KINDS))
    name = F.coalesce("n.alias", "n.identifier", "n.name")
    grain = F.lower("n.config.partition_by.granularity")
    return rows.select(
        F.coalesce("metadata.project_name", F.lit("")).alias("project"), "uid", F.concat_ws("/", F.coalesce("metadata.adapter_type", F.lit("dbt")), F.concat_ws(".", "n.database", "n.schema", name)).alias("ds"), F.col("n.resource_type").alias("kind"),
        F.coalesce("n.depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"), F.col("n.config.partition_by.field").alias("field"), F.when(grain.isin(*GRAINS), grain).alias("grain"), F.col("n.compiled_code").alias("sql"),
    )


def edges(tables: DataFrame) -> DataFrame:
    """(src, dst) between the tables of each manifest."""
    d = tables.select("project", F.col("ds").alias("dst"), F.explode("depends_on").alias("uid"))
    return d.join(tables.select("project", "uid", F.col("ds").alias("src")), ["project", "uid"]).select("src", "dst").distinct()
