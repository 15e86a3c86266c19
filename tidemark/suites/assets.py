"""Attribution, agents, contexts, contracts, approvals, replicas and graph health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import token_estimate
from tidemark.operators import assets as a
from tidemark.operators import graph as g
from tidemark.suites import digits, long, table
from tidemark.suites.graphs import part_edges


def drift_attribution(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    found = table(spark, sf, "part").where("p_partkey % 3 <> 1").select(k.alias("node"), F.when(k % 5 == 0, "error").when(k % 2 == 0, "warn").otherwise("info").alias("severity"), (k % 4 == 0).alias("on_column"))
    target = spark.createDataFrame([(144,)], "node long")
    return a.attribute(part_edges(spark, sf), target, found).select("node", long("hops").alias("hops"), digits("score").alias("score"))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs of agents (customers) that read parts; supplier 1 to 3 is outside."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_partkey") % 40).alias("ds"), (F.col("l_suppkey") <= 3).alias("egress"), F.col("l_suppkey").alias("target"))


def exfiltration_paths(spark: SparkSession, sf: str) -> DataFrame:
    sensitive = spark.createDataFrame([(7,), (11,)], "ds long")
    return a.exfiltration(_calls(spark, sf), sensitive)


def _access(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_type", "ts")


def first_time_access(spark: SparkSession, sf: str) -> DataFrame:
    e = _access(spark, sf)
    return a.first_time(e.where("ts >= '2024-01-08'"), e.where("ts < '2024-01-08'"), ["user_id", "event_type"])


def least_privilege_gap(spark: SparkSession, sf: str) -> DataFrame:
    granted = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(F.lit("error"), F.lit("click"))).alias("event_type"))
    return a.unused_grants(granted, _access(spark, sf), ["user_id", "event_type"])


def unreviewed_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that agent 1's parts feed and that others read."""
    e = part_edges(spark, sf)
    written = e.where("src % 50 = 1").select(F.col("dst").alias("node")).distinct()
    return written.join(e.select(F.col("src").alias("node")), "node", "left_semi")


def shared_ancestry(spark: SparkSession, sf: str) -> DataFrame:
    """What a training set (part 120) and an evaluation set (part 180) both come from."""
    return g.common_ancestors(part_edges(spark, sf), 120, 180).select("node")


def contract_breaches(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = lambda cols: spark.createDataFrame(cols, "name string, dtype string, nullable boolean")
    before = rows([(c, t, c == "o_orderstatus") for c, t in o.dtypes])
    after = rows([(c, "string" if c == "o_custkey" else t, c.endswith("priority") or c == "o_orderstatus") for c, t in o.dtypes if c != "o_totalprice"])
    return a.broken_promises(before, after)


def approval_states(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 10).alias("author"))
    votes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request"), (F.col("l_suppkey") % 10).alias("approver"), (F.col("l_partkey") % 11 != 0).alias("approve"))
    return a.approved(requests, votes, 2)


def replica_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Each priority's year is held by customers of three remainders; the order counts should agree."""
    r = table(spark, sf, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 3).alias("replica")).agg(F.count("*").cast("string").alias("fp"))
    return a.divergent(r, ["o_orderpriority", "y"], "fp").select("o_orderpriority", long("y").alias("year"), "n", "versions")


def shredded_rows(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").where("c_custkey % 20 <> 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 7 == 0).alias("destroyed"))
    return a.shredded(table(spark, sf, "orders"), keys, "o_custkey").select("o_orderkey")


def graph_health(spark: SparkSession, sf: str) -> DataFrame:
    e = part_edges(spark, sf).select("src", "dst", (F.col("src") % 4 != 0).alias("bounded"), (F.col("dst") % 3 == 0).alias("has_columns"), F.lit(2).alias("fields"), (F.col("src") % 3).alias("proven"))
    specced = table(spark, sf, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("node"))
    return a.health(e, specced).select(*[digits(c).alias(c) for c in ("specs", "bounded", "columns", "proven", "score")])


def wasted_context(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens"))
    return a.wasted_context(c, c.where("turn % 2 = 0"), ["conv_id", "turn"], "tokens")


def asset_kinds(spark: SparkSession, sf: str) -> DataFrame:
    schemes = F.element_at(F.array(*[F.lit(x) for x in ("model://r/", "vector-index://s/", "s3://lake/", "", "prompt://git/")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    uri = F.concat(schemes, "p_name")
    return table(spark, sf, "part").groupBy(a.kind_of(uri).alias("kind")).agg(F.count("*").alias("n"))


_NAMES = (drift_attribution, exfiltration_paths, first_time_access, least_privilege_gap, unreviewed_writes, shared_ancestry, contract_breaches, approval_states, replica_divergence, shredded_rows, graph_health, wasted_context, asset_kinds)
QUERIES = {f.__name__: f for f in _NAMES}

_E = """e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, unnest([p_partkey * 2, p_partkey * 2 + 1, p_partkey * 3]) AS dst FROM part)
  WHERE src <> dst AND dst IN (SELECT p_partkey FROM part))"""
_UP = "r AS (SELECT seed, seed AS node, 0::BIGINT AS depth FROM (VALUES {seeds}) s(seed) UNION SELECT seed, e.src, depth + 1 FROM r JOIN e ON e.dst = r.node{limit})"
_TOKENS = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END"
ORACLE_SQL = {
    "drift_attribution": f"""
WITH RECURSIVE {_E}, {_UP.format(seeds="(144)", limit=" WHERE depth < 6")}, h AS (SELECT node, min(depth) AS hops FROM r WHERE depth > 0 GROUP BY 1)
SELECT node::BIGINT AS node, hops, round(0.6::DOUBLE * CASE WHEN node % 5 = 0 THEN 1.0 WHEN node % 2 = 0 THEN 0.7 ELSE 0.3 END::DOUBLE + 0.3::DOUBLE * (1 - (hops - 1) / 6) + 0.1::DOUBLE * (node % 4 = 0)::INTEGER, 6) AS score FROM h WHERE node % 3 <> 1""",
    "exfiltration_paths": """
SELECT r.run, r.ds, s.target FROM (SELECT DISTINCT l_orderkey AS run, l_partkey % 40 AS ds FROM lineitem WHERE l_partkey % 40 IN (7, 11)) r JOIN (SELECT DISTINCT l_orderkey AS run, l_suppkey AS target FROM lineitem WHERE l_suppkey <= 3) s USING (run)""",
    "first_time_access": "SELECT DISTINCT user_id, event_type FROM events WHERE ts >= '2024-01-08' EXCEPT SELECT user_id, event_type FROM events WHERE ts < '2024-01-08'",
    "least_privilege_gap": "SELECT c_custkey AS user_id, unnest(['error', 'click']) AS event_type FROM customer EXCEPT SELECT user_id, event_type FROM events",
    "unreviewed_writes": f"WITH {_E} SELECT DISTINCT dst AS node FROM e WHERE src % 50 = 1 AND dst IN (SELECT src FROM e)",
    "shared_ancestry": f"WITH RECURSIVE {_E}, {_UP.format(seeds='(120), (180)', limit='')} SELECT node::BIGINT AS node FROM r WHERE depth > 0 GROUP BY node HAVING count(DISTINCT seed) = 2",
    "contract_breaches": "SELECT * FROM (VALUES ('o_totalprice', 'removed'), ('o_custkey', 'retyped'), ('o_orderpriority', 'nullable')) v(name, breach)",
    "approval_states": """
WITH v AS (SELECT o_orderkey AS request, count(DISTINCT CASE WHEN l_partkey % 11 <> 0 THEN l_suppkey % 10 END) AS yes, count(*) FILTER (l_partkey % 11 = 0) AS no
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey % 10 <> o_custkey % 10 GROUP BY 1)
SELECT o_orderkey AS request, CASE WHEN no > 0 THEN 'rejected' WHEN yes >= 2 THEN 'approved' ELSE 'pending' END AS state FROM orders LEFT JOIN v ON request = o_orderkey""",
    "replica_divergence": """
WITH r AS (SELECT o_orderpriority, year(o_orderdate) AS year, o_custkey % 3 AS k, count(*) AS fp FROM orders GROUP BY 1, 2, 3)
SELECT o_orderpriority, year, count(*) AS n, count(DISTINCT fp) AS versions FROM r GROUP BY 1, 2 HAVING count(DISTINCT fp) > 1""",
    "shredded_rows": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 20 <> 0 AND c_custkey % 7 <> 0)",
    "graph_health": f"""
WITH {_E}, n AS (SELECT avg((node % 5 <> 0)::INTEGER) AS specs FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)),
x AS (SELECT avg((src % 4 <> 0)::INTEGER) AS bounded, avg((dst % 3 = 0)::INTEGER) AS columns, sum(src % 3)::DOUBLE / (2 * count(*)) AS proven FROM e)
SELECT round(specs, 6) AS specs, round(bounded, 6) AS bounded, round(columns, 6) AS "columns", round(proven, 6) AS proven, round(0.3::DOUBLE * specs + 0.3::DOUBLE * bounded + 0.2::DOUBLE * columns + 0.2::DOUBLE * proven, 6) AS score FROM n, x""",
    "wasted_context": f"SELECT conv_id, sum(CASE WHEN turn % 2 = 0 THEN 0 ELSE {_TOKENS} END)::BIGINT AS wasted, sum({_TOKENS})::BIGINT AS tokens FROM conversations GROUP BY 1",
    "asset_kinds": "SELECT CASE p_partkey % 5 WHEN 0 THEN 'model' WHEN 1 THEN 'vector_index' WHEN 4 THEN 'prompt' ELSE 'table' END AS kind, count(*) AS n FROM part GROUP BY 1",
}


def _named_edges(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.when(F.col(c) % 2 == 0, F.lit("gold/p")).otherwise(F.lit("raw/p")), F.col(c).cast("string"))
    return part_edges(spark, sf).select(name("src").alias("src"), name("dst").alias("dst"))


def selector_language(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels above part 96 and one below part 5, with gold tables whose name has a 9 below part 3."""
    from tidemark.operators.selectors import select

    return select("2+gold/p96 raw/p5+1 raw/p3+,ns:gold,name:*9*", _named_edges(spark, sf))


def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.plans.naming import canonical_path, canonical_table

    k = F.col("c_custkey") % 6
    uri = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("s3a://Lake//Raw/", "gcs://Lake/Raw/", "wasbs://Box@Acct.blob.core.windows.net/Raw/", "/tmp//Raw/", "dbfs:/mnt/lake/Raw/", "/dbfs/mnt/lake/cold/")]), (k + 1).cast("int")), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit("/"))
    path = canonical_path(uri, {"/mnt/lake": "s3://store", "/mnt/lake/cold": "s3://cold/x"})
    named = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("", "Sales.", "Db.Sales.")]), (F.col("c_custkey") % 3 + 1).cast("int")), F.when(F.col("c_custkey") % 2 == 0, F.lit('"Mixed"')).otherwise(F.lit("Orders")))
    a, b = canonical_table(named, "Snowflake", "xy1", "prod", "main"), canonical_table(named, "duckdb", None, None, "Main")
    return table(spark, sf, "customer").select("c_custkey", path["namespace"].alias("namespace"), path["name"].alias("name"), F.concat_ws("/", a["namespace"], a["name"]).alias("snowflake"), F.concat_ws("/", b["namespace"], b["name"]).alias("duckdb"))


QUERIES |= {f.__name__: f for f in (selector_language, canonical_names)}
_NAMED = _E
_NAME = "CASE WHEN {c} % 2 = 0 THEN 'gold/p' ELSE 'raw/p' END || {c}"
ORACLE_SQL |= {
    "selector_language": f"""
WITH RECURSIVE {_NAMED}, up AS (SELECT 96::BIGINT AS n, 0 AS d UNION SELECT src, d + 1 FROM up JOIN e ON dst = n WHERE d < 2), low AS (SELECT 3::BIGINT AS n UNION SELECT dst FROM low JOIN e ON src = n),
s AS (SELECT n FROM up UNION SELECT 5 UNION SELECT dst FROM e WHERE src = 5 UNION SELECT n FROM low WHERE n % 2 = 0 AND n::VARCHAR LIKE '%9%')
SELECT {_NAME.format(c="n")} AS node FROM s""",
    "canonical_names": """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 's3://lake' WHEN 1 THEN 'gs://lake' WHEN 2 THEN 'abfss://box@acct' WHEN 3 THEN 'file' WHEN 4 THEN 's3://store' ELSE 's3://cold' END AS namespace,
  CASE c_custkey % 6 WHEN 3 THEN '/tmp/Raw/' WHEN 5 THEN 'x/' ELSE 'Raw/' END || replace(c_name, '#', '-') AS name,
  'snowflake://xy1/' || CASE c_custkey % 3 WHEN 0 THEN 'PROD.MAIN.' WHEN 1 THEN 'PROD.SALES.' ELSE 'DB.SALES.' END || CASE WHEN c_custkey % 2 = 0 THEN 'Mixed' ELSE 'ORDERS' END AS snowflake,
  'duckdb/' || CASE c_custkey % 3 WHEN 0 THEN 'main.' WHEN 1 THEN 'sales.' ELSE 'db.sales.' END || CASE WHEN c_custkey % 2 = 0 THEN 'Mixed' ELSE 'orders' END AS duckdb FROM customer""",
}
