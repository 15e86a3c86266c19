"""Partition algebra, invalidation, rebuilds, shadow runs and schedules."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import LEAST_SPAN, arrival_lag, reached, truncate, widened_window
from tidemark.operators import graph as g
from tidemark.plans import measures, rebuild
from tidemark.plans.invalidate import edges, invalidate, key, shown, stamp
from tidemark.plans.lattice import same, trailing, window
from tidemark.session import shared_dir
from tidemark.suites import day, digits, long, minute, table

#: The partition that lands late in the examples.
LATE = "1996-03-14"
LAYERS = (
    ("raw.orders", "silver.orders", {"dt": window("dt", "day"), "priority": same("priority")}),
    ("silver.orders", "gold.monthly", {"dt": window("dt", "month", fine="day"), "priority": same("priority")}),
    ("silver.orders", "gold.weekly", {"dt": trailing("dt", 7, "day")}),
    ("gold.monthly", "gold.yearly", {"dt": window("dt", "year", fine="month")}),
)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.col("o_orderpriority").alias("priority"))


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions in which an urgent order of over 30 customers' keys changed: urgent orders of keys divisible by 50."""
    rows = _orders(spark, sf).where("o_orderkey % 50 = 0 and priority = '1-URGENT'")
    return rows.select(F.lit("raw.orders").alias("ds"), key(dt=stamp(truncate("o_orderdate", "day")), priority=F.col("priority")).alias("key")).distinct()


def invalidation_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = invalidate(_dirty(spark, sf), edges(spark, LAYERS))
    return plan.select("ds", shown(F.col("key")).alias("partition"), F.col("hops").cast("int").alias("hops"))


def partition_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).withColumn("dt", day(truncate("o_orderdate", "month")))
    return rebuild.fingerprints(rows, ["dt", "priority"], ["o_orderkey", "o_custkey"])


def partition_digest_sums(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).withColumn("dt", day(truncate("o_orderdate", "month")))
    return rebuild.digest_sums(rows, ["dt", "priority"], ["o_orderkey", "o_custkey"])


def distinct_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select(day(truncate("o_orderdate", "month")).alias("dt"), "priority").distinct()


def dirty_keys_day_to_month(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).where("o_orderkey % 50 = 0").select(day(truncate("o_orderdate", "month")).alias("dt"), "priority").distinct()


def trailing_7d_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).where("o_orderkey % 50 = 0").select("o_orderdate").distinct()
    return rows.select(F.explode(reached("o_orderdate", 0, 6, "day")).alias("dt")).select(day("dt").alias("dt")).distinct()


def hour_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(minute(truncate("ts", "hour")).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


CONVERSIONS = (("hour", "day"), ("day", "month"), ("day", "year"), ("month", "year"))


def window_conversions(spark: SparkSession, sf: str) -> DataFrame:
    """The delays between orders and shipments as windows of days, in coarser grains."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    lag = F.date_diff("l_shipdate", "o_orderdate").cast("long")
    windows = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select((-lag).alias("lo"), (lag + F.col("l_linenumber")).alias("hi")).distinct()
    found = [windows.select(F.lit(f).alias("fine"), F.lit(c).alias("coarse"), "lo", "hi", widened_window("lo", "hi", f, c).alias("w")) for f, c in CONVERSIONS]
    return reduce(DataFrame.unionByName, found).select("fine", "coarse", "lo", "hi", F.col("w.lo").alias("out_lo"), F.col("w.hi").alias("out_hi"))


PRICES = (50_000.0, 150_000.0, 400_000.0)


def observed_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """What a rebuild of orders by priority counts of the rows it writes."""
    path = f"{shared_dir(spark)}/tidemark/observed-{uuid.uuid4().hex}"
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    m = measures.Measures({"rows": F.lit(1), "cents": cents, "urgent": (F.col("priority") == "1-URGENT").cast("int")}, {"last_key": F.col("o_orderkey")}, {"price": (F.col("o_totalprice"), PRICES)})
    return measures.write(_orders(spark, sf), path, m, ["priority"]).where("kind <> 'sum'").select("name", "kind", F.coalesce("bucket", F.lit(0.0)).alias("bucket"), "value")


def predicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    keys = [{"o_orderdate": "1996-03-01 00:00:00", "o_orderpriority": "1-URGENT"}, {"o_orderdate": "1997-01-01 00:00:00"}, {"o_orderdate": "1997-01-01 00:00:00"}]
    return table(spark, sf, "orders").where(rebuild.predicate(keys, {"o_orderdate": "month"})).select("o_orderkey", "o_custkey")


def _silver(rows: DataFrame) -> DataFrame:
    cents = (F.round(F.col("o_totalprice") * 100)).cast("long")
    return rows.groupBy(truncate("o_orderdate", "month").alias("dt"), "priority").agg(F.count("*").alias("n_orders"), F.sum(cents).alias("cents"))


def _before_after(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders without and with those that land late, and the late ones."""
    rows = _orders(spark, sf)
    late = rows.where("o_orderkey % 97 = 0 and o_custkey % 3 = 0")
    return rows.join(late.select("o_orderkey"), "o_orderkey", "left_anti"), rows, late


def incremental_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Old partitions that stay, and stale ones built anew from their source rows alone."""
    before, after, late = _before_after(spark, sf)
    stale = late.select(truncate("o_orderdate", "month").alias("dt"), "priority").distinct()
    old = _silver(before).join(stale, ["dt", "priority"], "left_anti")
    source = after.withColumn("dt", truncate("o_orderdate", "month")).join(stale, ["dt", "priority"], "left_semi")
    return old.unionByName(_silver(source)).select(day("dt").alias("dt"), "priority", "n_orders", "cents")


def _touched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    before, after, late = _before_after(spark, sf)
    month = day(truncate("o_orderdate", "month")).alias("dt")
    marks = [rebuild.digest_sums(x.select(month, "priority", "o_orderkey", "o_custkey"), ["dt", "priority"], ["o_orderkey", "o_custkey"]) for x in (before, after)]
    return rebuild.touched(*marks, ["dt", "priority"]), late.select(month, "priority").distinct(), marks[1]


def shadow_touched(spark: SparkSession, sf: str) -> DataFrame:
    return _touched(spark, sf)[0]


def shadow_sound(spark: SparkSession, sf: str) -> DataFrame:
    touched, planned, total = _touched(spark, sf)
    return rebuild.shadow(planned, touched, total, ["dt", "priority"]).select(*[long(c).alias(c) for c in ("planned", "touched", "missed", "wasted", "total")], digits("savings").alias("savings"), digits("precision").alias("precision"))


def shadow_unsound(spark: SparkSession, sf: str) -> DataFrame:
    """A plan that forgets urgent orders must be caught."""
    touched, planned, total = _touched(spark, sf)
    return rebuild.shadow(planned.where("priority <> '1-URGENT'"), touched, total, ["dt", "priority"]).select(long("planned").alias("planned"), long("missed").alias("missed"), (F.col("missed") == 0).alias("sound"))


def subject_erasure_rows(spark: SparkSession, sf: str) -> DataFrame:
    stays, goes = rebuild.erase(table(spark, sf, "orders"), "o_custkey", 37)
    day_of = truncate("o_orderdate", "month")
    a = goes.groupBy(day(day_of).alias("dt")).agg(F.count("*").alias("erased"))
    b = stays.groupBy(day(day_of).alias("dt")).agg(F.count("*").alias("kept"))
    return a.join(b, "dt", "left").select("dt", "erased", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


def schedule_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive stale days, cut into batches of at most 30."""
    from pyspark.sql import Window as W

    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 40).alias("shard")).distinct()
    w = W.partitionBy("shard").orderBy("d")
    new = F.when(F.date_diff("d", F.lag("d").over(w)) == 1, 0).otherwise(1)
    runs = days.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    at = F.row_number().over(W.partitionBy("shard", "run").orderBy("d")) - 1
    return runs.withColumn("batch", F.floor(at / 30)).groupBy("shard", "run", "batch").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("n")).select("shard", day("a").alias("first"), day("b").alias("last"), "n")


def arrival_lags(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    hours = F.floor(arrival_lag(truncate("o_orderdate", "day"), "l_shipdate", "day") / 86400)
    return rows.groupBy(long(hours).alias("days_late")).agg(F.count("*").alias("n"))


def late_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.where(arrival_lag(truncate("o_orderdate", "day"), "l_shipdate", "day") > 90 * 86400).select("l_orderkey", "l_linenumber", day("o_orderdate").alias("bucket"), day("l_shipdate").alias("observed"))


def rebuild_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Price of the planned partitions against a full rebuild, by priority."""
    rows = _orders(spark, sf).groupBy(truncate("o_orderdate", "month").alias("dt"), "priority").agg(F.count("*").alias("rows"), F.max((F.col("o_orderkey") % 97 == 0).cast("int")).alias("stale"))
    c = rows.groupBy("priority").agg(F.sum("rows").alias("full"), F.sum(F.col("rows") * F.col("stale")).alias("planned"))
    return c.select("priority", "full", "planned", F.greatest(F.lit(0), F.col("full") - F.col("planned")).cast("long").alias("avoided"), digits(1 - F.col("planned") / F.col("full")).alias("savings"))


def schedule_waves(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.suites.graphs import part_edges

    return g.waves(part_edges(spark, sf)).select(long("wave").alias("wave"), "n_nodes")


_NAMES = (invalidation_plan, partition_fingerprints, partition_digest_sums, distinct_partitions, dirty_keys_day_to_month, trailing_7d_keys, hour_rollup, window_conversions, observed_rebuild, predicate_rows, incremental_rebuild, shadow_touched, shadow_sound, shadow_unsound, subject_erasure_rows, schedule_batches, arrival_lags, late_arrivals, rebuild_cost, schedule_waves)
QUERIES = {f.__name__: f for f in _NAMES}

_LATE = "SELECT * FROM orders WHERE o_orderkey % 97 = 0 AND o_custkey % 3 = 0"
_MONTH = "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"
_HASH = "sum(CAST('0x' || left(md5(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR)), 15) AS UBIGINT))::VARCHAR"
_SHADOW = f"""
WITH p AS (SELECT DISTINCT {_MONTH} AS dt, o_orderpriority AS priority FROM ({_LATE}) {{where}}),
t AS (SELECT DISTINCT {_MONTH} AS dt, o_orderpriority AS priority FROM ({_LATE})),
n AS (SELECT count(*) AS total FROM (SELECT DISTINCT {_MONTH}, o_orderpriority FROM orders)),
c AS (SELECT (SELECT count(*) FROM p) AS planned, (SELECT count(*) FROM t) AS touched, (SELECT count(*) FROM t ANTI JOIN p USING (dt, priority)) AS missed, (SELECT count(*) FROM p ANTI JOIN t USING (dt, priority)) AS wasted, total FROM n)
"""
ORACLE_SQL = {
    "invalidation_plan": """
WITH raw AS (SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS d, o_orderpriority AS p FROM orders WHERE o_orderkey % 50 = 0 AND o_orderpriority = '1-URGENT'),
f AS (
  SELECT 'raw.orders' AS ds, d AS t, p, 0 AS hops FROM raw
  UNION SELECT 'silver.orders', d, p, 1 FROM raw
  UNION SELECT 'gold.monthly', date_trunc('month', d)::TIMESTAMP, p, 2 FROM raw
  UNION SELECT 'gold.weekly', d + to_days(i::INTEGER), NULL, 2 FROM raw, range(0, 7) r(i)
  UNION SELECT 'gold.yearly', date_trunc('year', d)::TIMESTAMP, NULL, 3 FROM raw
)
SELECT ds, 'dt=' || strftime(t, '%Y-%m-%d %H:%M:%S') || CASE WHEN p IS NULL THEN '' ELSE ',priority=' || p END AS partition, hops FROM f""",
    "partition_fingerprints": f"""
SELECT {_MONTH} AS dt, o_orderpriority AS priority, count(*) AS n_rows,
  md5(string_agg(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR), chr(30) ORDER BY concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR))) AS fp
FROM orders GROUP BY 1, 2""",
    "partition_digest_sums": f"SELECT {_MONTH} AS dt, o_orderpriority AS priority, count(*) AS n_rows, {_HASH} AS fp FROM orders GROUP BY 1, 2",
    "distinct_partitions": f"SELECT DISTINCT {_MONTH} AS dt, o_orderpriority AS priority FROM orders",
    "dirty_keys_day_to_month": f"SELECT DISTINCT {_MONTH} AS dt, o_orderpriority AS priority FROM orders WHERE o_orderkey % 50 = 0",
    "trailing_7d_keys": "SELECT DISTINCT strftime(date_trunc('day', o_orderdate) + to_days(i::INTEGER), '%Y-%m-%d') AS dt FROM orders, range(0, 7) r(i) WHERE o_orderkey % 50 = 0",
    "hour_rollup": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2",
    "window_conversions": f"""
SELECT fine, coarse, lo, hi, CASE WHEN lo >= 0 THEN 0 ELSE -(ceil(-lo / least)::BIGINT + 1) END AS out_lo, CASE WHEN hi <= 0 THEN 0 ELSE ceil(hi / least)::BIGINT + 1 END + 1 AS out_hi
FROM (SELECT DISTINCT -(l_shipdate::DATE - o_orderdate::DATE) AS lo, (l_shipdate::DATE - o_orderdate::DATE) + l_linenumber AS hi FROM orders JOIN lineitem ON l_orderkey = o_orderkey), (VALUES {", ".join(f"('{f}', '{c}', {LEAST_SPAN[f, c]})" for f, c in CONVERSIONS)}) v(fine, coarse, least)""",
    "observed_rebuild": f"""
SELECT name, kind, 0::DOUBLE AS bucket, value::DOUBLE AS value FROM (SELECT unnest(['rows', 'cents', 'urgent', 'last_key']) AS name, unnest(['counter', 'counter', 'counter', 'gauge']) AS kind, unnest([count(*), sum(round(o_totalprice * 100)::BIGINT), count(*) FILTER (o_orderpriority = '1-URGENT'), max(o_orderkey)]) AS value FROM orders)
UNION ALL SELECT 'price', 'histogram', b, (SELECT count(*) FROM orders WHERE o_totalprice <= b)::DOUBLE FROM (VALUES {", ".join(f"({p}::DOUBLE)" for p in PRICES)}, ('inf'::DOUBLE)) v(b)""",
    "predicate_rows": """
SELECT o_orderkey, o_custkey FROM orders
WHERE (date_trunc('month', o_orderdate) = TIMESTAMP '1996-03-01' AND o_orderpriority = '1-URGENT') OR date_trunc('month', o_orderdate) = TIMESTAMP '1997-01-01'""",
    "incremental_rebuild": f"SELECT {_MONTH} AS dt, o_orderpriority AS priority, count(*) AS n_orders, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders GROUP BY 1, 2",
    "shadow_touched": f"""
WITH a AS (SELECT {_MONTH} AS dt, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2),
l AS (SELECT {_MONTH} AS dt, o_orderpriority AS priority, count(*) AS n FROM ({_LATE}) GROUP BY 1, 2)
SELECT dt, priority, CASE WHEN a.n = l.n THEN 'new' ELSE 'changed' END AS change FROM l JOIN a USING (dt, priority)""",
    "shadow_sound": _SHADOW.format(where="") + "SELECT planned, touched, missed, wasted, total, round(1 - planned / total, 6) AS savings, round(CASE WHEN planned > 0 THEN 1 - wasted / planned ELSE 1.0 END, 6)::DOUBLE AS precision FROM c",
    "shadow_unsound": _SHADOW.format(where="WHERE o_orderpriority <> '1-URGENT'") + "SELECT planned, missed, missed = 0 AS sound FROM c",
    "subject_erasure_rows": f"""
SELECT {_MONTH} AS dt, count(*) FILTER (o_custkey = 37) AS erased, count(*) FILTER (o_custkey <> 37) AS kept FROM orders GROUP BY 1 HAVING count(*) FILTER (o_custkey = 37) > 0""",
    "schedule_batches": """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_custkey % 40 AS shard FROM orders),
r AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY shard ORDER BY d) AS INTEGER) AS island FROM d),
b AS (SELECT *, (row_number() OVER (PARTITION BY shard, island ORDER BY d) - 1) // 30 AS batch FROM r)
SELECT shard, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last, count(*) AS n FROM b GROUP BY shard, island, batch""",
    "arrival_lags": """
SELECT CAST(floor((epoch(l_shipdate) - epoch(date_trunc('day', o_orderdate) + INTERVAL 1 DAY)) / 86400) AS BIGINT) AS days_late, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "late_arrivals": """
SELECT l_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m-%d') AS bucket, strftime(l_shipdate, '%Y-%m-%d') AS observed
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE epoch(l_shipdate) - epoch(date_trunc('day', o_orderdate) + INTERVAL 1 DAY) > 90 * 86400""",
    "rebuild_cost": f"""
WITH r AS (SELECT {_MONTH} AS dt, o_orderpriority AS priority, count(*) AS n, max((o_orderkey % 97 = 0)::INTEGER) AS stale FROM orders GROUP BY 1, 2)
SELECT priority, sum(n)::BIGINT AS "full", sum(n * stale)::BIGINT AS planned, greatest(0, sum(n) - sum(n * stale))::BIGINT AS avoided, round(1 - sum(n * stale)::DOUBLE / sum(n), 6) AS savings
FROM r GROUP BY priority""",
}
