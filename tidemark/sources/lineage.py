"""Lineage from run events, access logs and SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_DATASET = "struct<namespace:string,name:string,facets:struct<columnLineage:struct<fields:map<string,struct<inputFields:array<struct<namespace:string,name:string,field:string>>>>>>>"
RUN_EVENT = f"eventType string, eventTime string, run struct<runId:string>, job struct<namespace:string,name:string>, inputs array<{_DATASET}>, outputs array<{_DATASET}>"
RANK = {"COMPLETE": 0, "RUNNING": 1, "START": 2}
#: Events that one task takes, about.
EVENTS = 500_000


def read_run_events(spark: SparkSession, path: str) -> DataFrame:
    """Run events of newline-delimited files; torn lines are dropped."""
    return spark.read.schema(f"{RUN_EVENT}, _torn string").option("columnNameOfCorruptRecord", "_torn").json(path).where("_torn is null").drop("_torn")


def collapse_runs(events: DataFrame) -> DataFrame:
    """One event for each run, the most complete; failed and aborted runs have none.

    Events are parted by run into as many parts as they need: what a task holds doesn't grow with them.
    """
    rank = F.lit(3)
    for kind, r in RANK.items():
        rank = F.when(F.col("eventType") == kind, F.lit(r)).otherwise(rank)
    n = max(events.agg(F.count("run.runId")).first()[0] // EVENTS + 1, events.sparkSession.sparkContext.defaultParallelism)
    w = W.partitionBy("_run")
    marked = events.withColumn("_run", F.col("run.runId")).repartition(n, "_run").withColumn("_dead", F.max(F.col("eventType").isin("FAIL", "ABORT").cast("int")).over(w)).withColumn("_r", F.row_number().over(w.orderBy(rank, F.desc("eventTime"))))
    return marked.where("_dead = 0 and _r = 1").drop("_run", "_dead", "_r")


def _name(d: Column) -> Column:
    return F.concat_ws("/", d["namespace"], d["name"])


def _live(events: DataFrame, said: list[Column], lineage: Callable[..., DataFrame]) -> DataFrame:
    """`lineage` of the runs that `collapse_runs` leaves, which depends on what their events say.

    Runs are collapsed with a digest of 128 bits of that in its place, as it is wide and
    mostly alike, and what an event says is made distinct where it is read.
    """
    marked = events.withColumn("_mark", F.struct(*[F.xxhash64(F.lit(i), *said).alias(f"h{i}") for i in (1, 2)]))
    kept = collapse_runs(marked.select("run", "eventType", "eventTime", "_mark")).select("_mark").distinct()
    return lineage(marked, "_mark").join(kept, "_mark", "left_semi").drop("_mark").distinct()


def run_edges(runs: DataFrame, *also: str) -> DataFrame:
    """(src, dst) of all inputs and outputs of each run, loops left out, and what else is asked for."""
    io = runs.select(*also, F.explode("inputs").alias("i"), "outputs").select(*also, "i", F.explode("outputs").alias("o"))
    return io.select(*also, _name(F.col("i")).alias("src"), _name(F.col("o")).alias("dst")).where("src <> dst").distinct()


def live_edges(events: DataFrame) -> DataFrame:
    """`run_edges` of the runs that `collapse_runs` leaves."""
    return _live(events, [F.col(f"{c}.{x}") for c in ("inputs", "outputs") for x in ("namespace", "name")], run_edges)


def run_columns(runs: DataFrame, *also: str) -> DataFrame:
    """(src, src_col, dst, dst_col) of the column-lineage facet, and what else is asked for."""
    out = runs.select(*also, F.explode("outputs").alias("o")).select(*also, _name(F.col("o")).alias("dst"), F.explode("o.facets.columnLineage.fields").alias("dst_col", "f"))
    cols = out.select(*also, "dst", "dst_col", F.explode("f.inputFields").alias("x"))
    return cols.select(*also, _name(F.col("x")).alias("src"), F.col("x.field").alias("src_col"), "dst", "dst_col").where("src <> dst").distinct()


def live_columns(events: DataFrame) -> DataFrame:
    """`run_columns` of the runs that `collapse_runs` leaves."""
    names = [F.col(f"outputs.{x}") for x in ("namespace", "name")]
    fields = F.transform("outputs", lambda o: F.map_entries(o["facets"]["columnLineage"]["fields"]))
    return _live(events, [*names, fields], run_columns)


def access_columns(history: DataFrame) -> DataFrame:
    """(src, src_col, dst, dst_col) of nested access-history rows: objects_modified with columns and their sources."""
    o = history.select(F.explode("objects_modified").alias("o")).select(F.col("o.objectName").alias("dst"), F.explode("o.columns").alias("c"))
    s = o.select("dst", F.col("c.columnName").alias("dst_col"), F.explode("c.directSources").alias("s"))
    return s.select(F.col("s.objectName").alias("src"), F.col("s.columnName").alias("src_col"), "dst", "dst_col").distinct()


def partition_id_time(pid: Column) -> Column:
    """The time of a partition id of 4, 6, 8 or 10 digits; null for others."""
    n = F.length(pid)
    forms = {4: "yyyy", 6: "yyyyMM", 8: "yyyyMMdd", 10: "yyyyMMddHH"}
    out = F.lit(None).cast("timestamp")
    for k, f in forms.items():
        out = F.when((n == k) & pid.rlike(r"^\d+$"), F.try_to_timestamp(pid, F.lit(f))).otherwise(out)
    return out.cast("timestamp_ntz")
