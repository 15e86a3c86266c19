"""Sources, logs, lineage, selections and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import glob
from tidemark.sources import delta, footers, lineage, paths
from tidemark.streaming import events as stream
from tidemark.suites import day, long, minute, table


def hive_path_keys(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    region = F.when(F.col("o_orderkey") % 5 == 0, F.lit("/region=__HIVE_DEFAULT_PARTITION__")).when(F.col("o_orderkey") % 5 == 1, F.lit("")).otherwise(F.concat(F.lit("/region="), F.regexp_replace("o_orderpriority", " ", "%20")))
    path = F.concat(F.lit("s3://lake/orders/dt="), F.date_format("o_orderdate", "yyyy-MM-dd"), region, F.lit("/part-0.parquet"))
    r = paths.hive_value(path, "region")
    return o.select("o_orderkey", day(paths.hive_time(path, "dt")).alias("dt"), r["found"].alias("found"), r["value"].alias("region"))


def template_paths(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    path = F.concat(F.lit("lake/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/c"), F.col("o_custkey"), F.lit("/x.parquet"))
    t = "{yyyy}/{MM}/{dd}/{customer}/"
    return o.select("o_orderkey", day(paths.template_time(path, t)).alias("dt"), paths.template_values(path, t)["customer"].alias("customer"))


def listing_changes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("path"), F.col("o_custkey").alias("size"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("timestamp")).alias("modified"), "o_orderkey")
    before = o.where("o_orderkey % 20 <> 3").withColumn("size", F.when(F.col("o_orderkey") % 30 == 7, F.lit(-1)).otherwise(F.col("size")))
    return paths.touched(o, before).select("path")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of orders' files: each order adds a file, of which later orders with the same remainder remove or rewrite it."""
    o = table(spark, sf, "orders")
    action = F.when(F.col("o_orderkey") % 7 == 0, "remove").otherwise("add")
    return o.select(F.col("o_orderkey").alias("version"), action.alias("action"), F.concat(F.lit("f"), F.col("o_orderkey") % 300).alias("path"), F.create_map(F.lit("dt"), day("o_orderdate"), F.lit("p"), F.left("o_orderpriority", F.lit(1))).alias("values"), (F.col("o_orderkey") % 4 != 0).alias("change"))


def delta_live_files(spark: SparkSession, sf: str) -> DataFrame:
    return delta.live_files(_log(spark, sf))


def delta_changed_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return delta.changed_partitions(_log(spark, sf), 1000)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events of orders: each customer is a job, each order a run of two events, some of which fail."""
    o = table(spark, sf, "orders")
    ds = lambda ns, name: F.struct(F.lit(ns).alias("namespace"), name.cast("string").alias("name"), F.lit(None).cast("struct<columnLineage:struct<fields:map<string,struct<inputFields:array<struct<namespace:string,name:string,field:string>>>>>>").alias("facets"))
    field = F.struct(F.array(F.struct(F.lit("raw").alias("namespace"), (F.col("o_custkey") % 10).cast("string").alias("name"), F.lit("amount").alias("field"))).alias("inputFields"))
    facets = F.struct(F.struct(F.create_map(F.lit("revenue"), field).alias("fields")).alias("columnLineage"))
    out = F.struct(F.lit("gold").alias("namespace"), F.left("o_orderpriority", F.lit(1)).alias("name"), facets.alias("facets"))
    kinds = F.explode(F.array(F.lit("START"), F.when(F.col("o_orderkey") % 9 == 0, "FAIL").when(F.col("o_orderkey") % 9 == 1, "RUNNING").otherwise("COMPLETE"))).alias("eventType")
    return o.select(kinds, F.col("o_orderkey").cast("string").alias("eventTime"), F.struct(F.col("o_orderkey").cast("string").alias("runId")).alias("run"), F.array(ds("raw", F.col("o_custkey") % 10), ds("gold", F.left("o_orderpriority", F.lit(1)))).alias("inputs"), F.array(out).alias("outputs"))


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.collapse_runs(_runs(spark, sf)).select(F.col("run.runId").alias("run"), "eventType")


def run_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.live_edges(_runs(spark, sf))


def run_column_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.live_columns(_runs(spark, sf))


def access_lineage(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "lineitem")
    src = F.array(F.struct(F.concat(F.lit("PART"), F.col("l_partkey") % 10).alias("objectName"), F.lit("AMOUNT").alias("columnName")), F.struct(F.concat(F.lit("SUPP"), F.col("l_suppkey") % 3).alias("objectName"), F.lit("KEY").alias("columnName")))
    cols = F.array(F.struct(F.lit("REVENUE").alias("columnName"), src.alias("directSources")))
    rows = o.select(F.array(F.struct(F.concat(F.lit("OUT"), F.col("l_linenumber")).alias("objectName"), cols.alias("columns"))).alias("objects_modified"))
    return lineage.access_columns(rows)


def partition_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pid = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyyMM")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy")).otherwise(F.lit("__NULL__"))
    return o.select("o_orderkey", day(lineage.partition_id_time(pid)).alias("dt"))


def footer_profile(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "orders").select(F.col("_metadata.file_path").alias("path")).distinct()
    return footers.footer_profile(files).select("name", "row_count", "null_count")


def watermark_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions that changed after a watermark, with their new one."""
    o = table(spark, sf, "orders").where("o_orderdate > '2001-01-01'")
    return o.groupBy("o_orderpriority").agg(minute(F.max("o_orderdate")).alias("watermark"), F.count("*").alias("n"))


def glob_selection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_name").rlike(glob("*gear*")) & F.col("p_brand").rlike(glob("Brand#1?"))).select("p_partkey")


def selector_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of one nation or segment, less those without orders, less a range."""
    c = table(spark, sf, "customer")
    a, b = c.where("c_nationkey = 3").select("c_custkey"), c.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return a.union(b).intersect(o).subtract(c.where("c_custkey between 20 and 60").select("c_custkey"))


def quiet_alerts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error'").select((F.col("user_id") % 50).alias("fingerprint"), "ts")
    a = stream.quiet_alerts(e, "fingerprint", "ts", 7200)
    return a.groupBy("fingerprint").agg(F.min("sent").alias("first"), F.max("sent").alias("last"), F.count("*").alias("n"))


def window_rollup(spark: SparkSession, sf: str) -> DataFrame:
    r = stream.rollup(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"], "1 hour")
    return r.select(day("start").alias("day"), "event_type", "n")


def session_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = stream.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["user_id"], "1 hour")
    return r.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def alert_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts that a route of warnings and worse takes outside quiet hours (22 to 7), or at any time when critical."""
    rank = F.when(F.col("value") > 90, 3).when(F.col("value") > 60, 2).when(F.col("value") > 30, 1).otherwise(0)
    quiet = (F.hour("ts") >= 22) | (F.hour("ts") < 7)
    e = table(spark, sf, "events").select("event_id", "event_type", rank.alias("rank"), quiet.alias("quiet"))
    return e.where("rank >= 1 and event_type in ('error', 'purchase') and (not quiet or rank = 3)").select("event_id", long("rank").alias("rank"))


_NAMES = (hive_path_keys, template_paths, listing_changes, delta_live_files, delta_changed_partitions, run_events, run_lineage, run_column_lineage, access_lineage, partition_ids, footer_profile, watermark_scan, glob_selection, selector_sets, quiet_alerts, window_rollup, session_runs, alert_routes)
QUERIES = {f.__name__: f for f in _NAMES}

_RUNS = """r AS (SELECT o_orderkey, o_custkey % 10 AS c, left(o_orderpriority, 1) AS p FROM orders WHERE o_orderkey % 9 <> 0)"""
ORACLE_SQL = {
    "hive_path_keys": """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dt, o_orderkey % 5 <> 1 AS found, CASE WHEN o_orderkey % 5 > 1 THEN o_orderpriority END AS region FROM orders""",
    "template_paths": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dt, 'c' || o_custkey AS customer FROM orders",
    "listing_changes": "SELECT 'f' || o_orderkey AS path FROM orders WHERE o_orderkey % 20 = 3 OR o_orderkey % 30 = 7 OR o_orderkey % 50 = 0",
    "delta_live_files": "SELECT 'f' || (o_orderkey % 300) AS path FROM orders GROUP BY o_orderkey % 300 HAVING max(o_orderkey) % 7 <> 0",
    "delta_changed_partitions": """
SELECT DISTINCT '[{"key":"dt","value":"' || strftime(o_orderdate, '%Y-%m-%d') || '"},{"key":"p","value":"' || left(o_orderpriority, 1) || '"}]' AS partition FROM orders WHERE o_orderkey > 1000 AND o_orderkey % 4 <> 0""",
    "run_events": f"WITH {_RUNS} SELECT o_orderkey::VARCHAR AS run, CASE WHEN o_orderkey % 9 = 1 THEN 'RUNNING' ELSE 'COMPLETE' END AS \"eventType\" FROM r",
    "run_lineage": f"WITH {_RUNS} SELECT DISTINCT 'raw/' || c AS src, 'gold/' || p AS dst FROM r",
    "run_column_lineage": f"WITH {_RUNS} SELECT DISTINCT 'raw/' || c AS src, 'amount' AS src_col, 'gold/' || p AS dst, 'revenue' AS dst_col FROM r",
    "access_lineage": """
SELECT DISTINCT 'PART' || (l_partkey % 10) AS src, 'AMOUNT' AS src_col, 'OUT' || l_linenumber AS dst, 'REVENUE' AS dst_col FROM lineitem
UNION SELECT DISTINCT 'SUPP' || (l_suppkey % 3), 'KEY', 'OUT' || l_linenumber, 'REVENUE' FROM lineitem""",
    "partition_ids": """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(o_orderdate, '%Y-01-01') END AS dt FROM orders""",
    "footer_profile": "SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS name, count(*) AS row_count, 0::BIGINT AS null_count FROM orders",
    "watermark_scan": "SELECT o_orderpriority, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS watermark, count(*) AS n FROM orders WHERE o_orderdate > '2001-01-01' GROUP BY 1",
    "glob_selection": "SELECT p_partkey FROM part WHERE p_name LIKE '%gear%' AND p_brand LIKE 'Brand#1_'",
    "selector_sets": "SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR c_mktsegment = 'BUILDING') AND c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT BETWEEN 20 AND 60",
    "quiet_alerts": """
WITH RECURSIVE t AS (SELECT DISTINCT user_id % 50 AS f, floor(epoch(ts))::BIGINT AS s FROM events WHERE event_type = 'error'),
r AS (SELECT f, min(s) AS s FROM t GROUP BY 1 UNION ALL SELECT r.f, (SELECT min(t.s) FROM t WHERE t.f = r.f AND t.s >= r.s + 7200) FROM r WHERE r.s IS NOT NULL)
SELECT f AS fingerprint, min(s) AS first, max(s) AS last, count(*) AS n FROM r WHERE s IS NOT NULL GROUP BY 1""",
    "window_rollup": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "session_runs": """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS > ts THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "alert_routes": """
WITH e AS (SELECT event_id, event_type, hour(ts) AS h, CASE WHEN value > 90 THEN 3 WHEN value > 60 THEN 2 WHEN value > 30 THEN 1 ELSE 0 END::BIGINT AS rank FROM events)
SELECT event_id, rank FROM e WHERE rank >= 1 AND event_type IN ('error', 'purchase') AND (NOT (h >= 22 OR h < 7) OR rank = 3)""",
}
