"""Profiles, drift, completeness, seasonality, joins, usage, cost and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import step, truncate
from tidemark.operators import observe as o
from tidemark.suites import day, digits, long, minute, table


def _half(spark: SparkSession, sf: str, name: str = "orders") -> tuple[DataFrame, DataFrame]:
    """Orders of even and of odd customers, the latter with a price missing for every fifth key and no status."""
    rows = table(spark, sf, name).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    odd = rows.where("o_custkey % 2 = 1 and o_custkey % 3 = 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))).drop("o_orderstatus").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("tier", F.lit(1))
    return rows.where("o_custkey % 2 = 0"), odd


def profile_scan(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    rows = table(spark, sf, "orders").withColumn("o_custkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")))
    return o.profile(rows, cols).select("name", "row_count", "null_count", "min", "max", "distinct")


def profile_by_month(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("dt", day(truncate("o_orderdate", "month")))
    return o.profile_by(rows, ["dt"], "o_orderkey").drop("distinct")


def drift_findings(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _half(spark, sf)
    return o.drift(o.profile(before), o.profile(after))


def schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    before, after = (spark.createDataFrame(x.dtypes, "name string, dtype string") for x in _half(spark, sf))
    return o.schema_diff(before, after)


def latest_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return o.latest(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


def gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", truncate("o_orderdate", "day").alias("dt"))
    return o.gap_runs(rows, ["o_custkey"], "dt", "day").select("o_custkey", day("first").alias("first"), day("last").alias("last"), "n")


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Days of 1996 by priority against the days that have orders of even customers."""
    kinds = table(spark, sf, "orders").select("o_orderpriority").distinct()
    expected = kinds.withColumn("dt", F.explode(F.sequence(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"), F.expr("interval 1 day"))))
    present = table(spark, sf, "orders").where("o_custkey % 2 = 0 and o_orderdate >= '1996-01-05' and o_orderdate < '1997-01-04'").select("o_orderpriority", truncate("o_orderdate", "day").alias("dt"))
    return o.completeness(expected, present, ["o_orderpriority", "dt"]).select(long("expected").alias("expected"), long("missing").alias("missing"), long("unexpected").alias("unexpected"), digits("ratio").alias("ratio"))


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's lines are arrivals of its day by flag; the digest repeats where discounts do."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.when(F.col("l_orderkey") % 9 != 0, (F.col("l_orderkey") % 2 + F.when(F.col("l_orderkey") % 4 == 0, F.col("l_linenumber")).otherwise(0)).cast("string")).alias("digest"))


def replays(spark: SparkSession, sf: str) -> DataFrame:
    return o.repeats(_arrivals(spark, sf), ["l_orderkey", "l_returnflag"], "digest").where("kind = 'replay'").select("l_orderkey", "l_returnflag", "n")


def restatements(spark: SparkSession, sf: str) -> DataFrame:
    return o.repeats(_arrivals(spark, sf), ["l_orderkey", "l_returnflag"], "digest").where("kind = 'restatement'").select("l_orderkey", "l_returnflag", "n")


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(truncate("o_orderdate", "day").alias("dt")).agg(F.count("*").alias("n"))


def seasonal_bands(spark: SparkSession, sf: str) -> DataFrame:
    b = o.seasonal_bands(_daily(spark, sf).where("dt < '1999-01-01'"), "dt", "n", "weekday")
    return b.select(long("bucket").alias("weekday"), "n", digits("low").alias("low"), digits("high").alias("high"))


def seasonal_violations(spark: SparkSession, sf: str) -> DataFrame:
    daily = _daily(spark, sf)
    bands = o.seasonal_bands(daily.where("dt < '1997-01-01'"), "dt", "n", "month_of_year", margin=0.0).drop("n")
    return o.seasonal_violations(daily.where("dt >= '1997-01-01'"), bands, "dt", "n", "month_of_year").select(day("dt").alias("dt"), "n")


def cycle_strength(spark: SparkSession, sf: str) -> DataFrame:
    hourly = table(spark, sf, "events").groupBy(truncate("ts", "hour").alias("h")).agg(F.count("*").alias("n"))
    return o.cycle_strength(hourly, "h", "n", "hour_of_day").select(digits("strength").alias("strength"))


def join_key_shape(spark: SparkSession, sf: str) -> DataFrame:
    a = o.key_shape(table(spark, sf, "orders"), "o_custkey").withColumn("key", F.lit("o_custkey"))
    b = o.key_shape(table(spark, sf, "orders"), "o_orderkey").withColumn("key", F.lit("o_orderkey"))
    return a.unionByName(b).select("key", "n_rows", "n_distinct", digits("fan_out").alias("fan_out"), "is_unique")


def orphan_keys(spark: SparkSession, sf: str) -> DataFrame:
    return o.orphans(table(spark, sf, "lineitem").where("l_orderkey % 3 = 0"), table(spark, sf, "orders").where("o_orderkey % 2 = 0"), "l_orderkey", "o_orderkey")


def join_amplification(spark: SparkSession, sf: str) -> DataFrame:
    a = o.amplification(table(spark, sf, "orders"), table(spark, sf, "events"), "o_custkey", "user_id")
    return a.select(long("n_out").alias("n_out"), digits("amplification").alias("amplification"))


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    who = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("svc_"), "user_id")).otherwise(F.concat(F.lit("u"), "user_id"))
    return table(spark, sf, "events").select("event_type", who.alias("who"), "ts")


def usage_stats(spark: SparkSession, sf: str) -> DataFrame:
    u = o.usage(_reads(spark, sf), "event_type", "who", "ts")
    return u.select("ds", "n_reads", "n_principals", "n_human", minute("first_read").alias("first_read"), minute("last_read").alias("last_read"))


def never_read(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose number no event has."""
    return o.orphans(table(spark, sf, "customer"), table(spark, sf, "events").where("event_type <> 'error'"), "c_custkey", "user_id")


def lifetime_cost(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", F.col("l_shipdate").alias("at"))
    g = rows.groupBy("l_suppkey").agg(F.count("*").alias("runs"), F.sum(long("l_quantity")).alias("units"), F.min("at").alias("a"), F.max("at").alias("b"))
    spend = F.col("runs") * 0.25 + F.col("units") * 0.01
    return g.select("l_suppkey", "runs", "units", digits(spend).alias("spend"), digits(spend / F.col("runs")).alias("per_run"), long(F.date_diff("b", "a")).alias("days"))


def billing_by_period(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = table(spark, sf, "orders").select(day(truncate("o_orderdate", "month")).alias("period"), "o_orderpriority", cents.alias("cents"), F.to_date("o_orderdate").alias("d"))
    return rows.groupBy("period").agg(F.sum("cents").alias("cents"), F.count_distinct("d").alias("n_days"), F.sum(F.when(F.col("o_orderpriority") != "5-LOW", F.col("cents")).otherwise(0)).alias("attributed"))


def billing_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Modelled (a price for each line) against billed cost of each year."""
    billed = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("billed"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))
    model = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.year("o_orderdate").alias("y")).agg((F.count("*") * 1000).alias("modelled"))
    return billed.join(model, "y", "left").select(long("y").alias("year"), "billed", "modelled", digits(F.col("billed") / F.col("modelled")).alias("correction"), (F.col("days") >= 14).alias("reliable"))


def quality_suite_check(spark: SparkSession, sf: str) -> DataFrame:
    every = F.lit(True)
    rules = [
        ("price_positive", every, F.col("o_totalprice") > 0),
        ("status_known", every, F.col("o_orderstatus").isin("O", "F")),
        ("urgent_is_large", F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 50_000),
        ("date_in_range", every, F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("2000-12-31").cast("timestamp_ntz"))),
    ]
    return o.suite(table(spark, sf, "orders"), rules)


def learned_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("q", long("l_quantity"))
    return o.learn_bounds(rows, ["l_returnflag"], "q").select("l_returnflag", digits("low").alias("low"), digits("high").alias("high"))


def incident_groups(spark: SparkSession, sf: str) -> DataFrame:
    errors = table(spark, sf, "events").where("event_type = 'error'").select((F.col("user_id") % 5).alias("service"), truncate("ts", "hour").alias("at")).distinct()
    groups = o.incident_groups(errors, 3600, "service", "at")
    return groups.groupBy("service", minute("incident").alias("incident")).agg(F.count("*").alias("n"))


def mttd_mttr(spark: SparkSession, sf: str) -> DataFrame:
    """Mean seconds from each user's first error of a day to the day's next and last events."""
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min(F.when(F.col("event_type") == "error", F.unix_timestamp(F.col("ts").cast("timestamp")))).alias("started"), F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("ended"), F.min(F.when(F.col("event_type") == "click", F.unix_timestamp(F.col("ts").cast("timestamp")))).alias("found"))
    e = e.where("started is not null")
    return e.agg(F.count("*").alias("n"), digits(F.avg(F.when(F.col("found") >= F.col("started"), F.col("found") - F.col("started")))).alias("mttd"), digits(F.avg(F.col("ended") - F.col("started"))).alias("mttr"))


def freshness_offenders(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by days since their last order times their orders, the worst ten."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    age = F.date_diff(F.lit("2001-08-02").cast("date"), "last")
    return g.select("o_custkey", long(age).alias("age"), long(age * F.greatest(F.lit(1), F.col("n"))).alias("score")).orderBy(F.desc("score"), "o_custkey").limit(10)


def histogram_quantile(spark: SparkSession, sf: str) -> DataFrame:
    upper = F.array([F.lit(x) for x in (5.0, 10.0, 20.0, 35.0, 50.0)])
    rows = table(spark, sf, "lineitem").select(F.get(F.filter(upper, lambda u: F.col("l_quantity") <= u), 0).alias("upper"))
    counts = rows.groupBy("upper").agg(F.count("*").alias("n"))
    parts = [o.quantile_from_buckets(counts, "upper", "n", q).select(F.lit(q).alias("q"), digits("value").alias("value")) for q in (0.5, 0.95)]
    return parts[0].unionByName(parts[1])


def missed_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of the events' span without an error."""
    e = table(spark, sf, "events").select(truncate("ts", "hour").alias("h"), "event_type")
    span = e.agg(F.min("h").alias("a"), F.max("h").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("h"))
    return span.join(e.where("event_type = 'error'"), "h", "left_anti").select(minute("h").alias("hour"), minute(step("h", 1, "hour")).alias("until"))


_NAMES = (profile_scan, profile_by_month, drift_findings, schema_diff, latest_profile, gap_runs, completeness, replays, restatements, seasonal_bands, seasonal_violations, cycle_strength, join_key_shape, orphan_keys, join_amplification, usage_stats, never_read, lifetime_cost, billing_by_period, billing_reconcile, quality_suite_check, learned_bounds, incident_groups, mttd_mttr, freshness_offenders, histogram_quantile, missed_buckets)
QUERIES = {f.__name__: f for f in _NAMES}

_MONTH = "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"
_DAILY = "SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS dt, count(*) AS n FROM orders GROUP BY 1"
_ARR = "SELECT l_orderkey, l_returnflag, CASE WHEN l_orderkey % 9 <> 0 THEN (l_orderkey % 2 + CASE WHEN l_orderkey % 4 = 0 THEN l_linenumber ELSE 0 END)::VARCHAR END AS digest FROM lineitem"
_REPEATS = f"SELECT l_orderkey, l_returnflag, count(*) AS n FROM ({_ARR}) GROUP BY 1, 2 HAVING count(*) > 1 AND {{no}}(count(DISTINCT digest) = 1 AND count(digest) = count(*))"


def _profile(col: str, expr: str) -> str:
    return f"SELECT '{col}' AS name, count(*) AS row_count, count(*) - count({expr}) AS null_count, min({expr})::VARCHAR AS min, max({expr})::VARCHAR AS max, count(DISTINCT {expr}) AS \"distinct\" FROM orders"


_B, _A = "FROM orders WHERE o_custkey % 2 = 0", "FROM orders WHERE o_custkey % 2 = 1 AND o_custkey % 3 = 0"
ORACLE_SQL = {
    "profile_scan": " UNION ALL ".join([_profile("o_orderkey", "o_orderkey"), _profile("o_custkey", "CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END"), _profile("o_orderstatus", "o_orderstatus"), _profile("o_orderpriority", "o_orderpriority")]),
    "profile_by_month": f"SELECT {_MONTH} AS dt, count(*) AS row_count, count(*) - count(o_orderkey) AS null_count, min(o_orderkey) AS min, max(o_orderkey) AS max FROM orders GROUP BY 1",
    "drift_findings": f"""
WITH b AS (SELECT count(*) AS n, min(o_orderkey) AS klo, max(o_orderkey) AS khi, min(o_custkey) AS clo, max(o_custkey) AS chi, min(o_totalprice) AS plo, max(o_totalprice) AS phi {_B}),
a AS (SELECT count(*) AS n, min(o_orderkey) AS klo, max(o_orderkey) AS khi, min(o_custkey::VARCHAR)::BIGINT AS clo, max(o_custkey::VARCHAR)::BIGINT AS chi, min(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END) AS plo, max(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END) AS phi, avg((o_orderkey % 5 = 0)::INTEGER) AS nulls {_A}),
x AS (SELECT a.n AS an, b.n AS bn, CASE WHEN least(a.n, b.n) < 1000 THEN 'info' ELSE 'warn' END AS soft, a.*, b.klo AS bklo, b.khi AS bkhi, b.clo AS bclo, b.chi AS bchi, b.plo AS bplo, b.phi AS bphi FROM a, b)
SELECT 'o_orderstatus' AS name, 'column_removed' AS kind, 'error' AS severity UNION ALL SELECT 'tier', 'column_added', 'info' UNION ALL SELECT 'o_custkey', 'type_changed', 'error'
UNION ALL SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderpriority']), 'row_count', soft FROM x WHERE abs(an / bn - 1) > 0.25
UNION ALL SELECT 'o_totalprice', 'null_rate', soft FROM x WHERE abs(nulls) > 0.05
UNION ALL SELECT name, 'min_raised', 'info' FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) AS name, unnest([klo > bklo, clo > bclo, plo > bplo]) AS hit FROM x) WHERE hit
UNION ALL SELECT name, 'max_lowered', 'info' FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) AS name, unnest([khi < bkhi, chi < bchi, phi < bphi]) AS hit FROM x) WHERE hit""",
    "schema_diff": "SELECT * FROM (VALUES ('o_orderstatus', 'removed', 'string', NULL), ('tier', 'added', NULL, 'int'), ('o_custkey', 'retyped', 'bigint', 'string')) v(name, change, before, after)",
    "latest_profile": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "gap_runs": """
WITH d AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS d FROM orders),
n AS (SELECT *, lead(d) OVER (PARTITION BY o_custkey ORDER BY d) AS nx FROM d)
SELECT o_custkey, strftime(d + 1, '%Y-%m-%d') AS first, strftime(nx - 1, '%Y-%m-%d') AS last, (nx - d - 1)::BIGINT AS n FROM n WHERE nx > d + 1""",
    "completeness": """
WITH e AS (SELECT p, d::TIMESTAMP AS d FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY) s(d)),
q AS (SELECT DISTINCT o_orderpriority AS p, date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders WHERE o_custkey % 2 = 0 AND o_orderdate >= '1996-01-05' AND o_orderdate < '1997-01-04')
SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM e ANTI JOIN q USING (p, d)) AS missing, (SELECT count(*) FROM q ANTI JOIN e USING (p, d)) AS unexpected,
  round(1 - (SELECT count(*) FROM e ANTI JOIN q USING (p, d)) / (SELECT count(*) FROM e), 6) AS ratio""",
    "replays": _REPEATS.format(no=""),
    "restatements": _REPEATS.format(no="NOT "),
    "seasonal_bands": f"""
WITH g AS (SELECT isodow(dt) - 1 AS weekday, count(*) AS n, min(n) AS lo, max(n) AS hi FROM ({_DAILY}) WHERE dt < '1999-01-01' GROUP BY 1 HAVING count(*) >= 4)
SELECT weekday::BIGINT AS weekday, n, round(lo - greatest((hi - lo) * 0.1::DOUBLE, abs(hi) * 0.1::DOUBLE, 1e-9), 6) AS low, round(hi + greatest((hi - lo) * 0.1::DOUBLE, abs(hi) * 0.1::DOUBLE, 1e-9), 6) AS high FROM g""",
    "seasonal_violations": f"""
WITH d AS ({_DAILY}), g AS (SELECT month(dt) AS m, min(n) AS lo, max(n) AS hi FROM d WHERE dt < '1997-01-01' GROUP BY 1 HAVING count(*) >= 4)
SELECT strftime(dt, '%Y-%m-%d') AS dt, n FROM d JOIN g ON month(dt) = m WHERE dt >= '1997-01-01' AND (n < lo - 1e-9 OR n > hi + 1e-9)""",
    "cycle_strength": """
WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*)::DOUBLE AS n FROM events GROUP BY 1), g AS (SELECT hour(h) AS b, count(*) AS k, avg(n) AS m FROM h GROUP BY 1), t AS (SELECT avg(n) AS m, var_pop(n) * count(*) AS v FROM h)
SELECT round(least(1, greatest(0, (SELECT sum(k * (g.m - t.m) * (g.m - t.m)) FROM g) / v)), 6)::DOUBLE AS strength FROM t""",
    "join_key_shape": """
SELECT 'o_custkey' AS key, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_distinct, round(count(*) / count(DISTINCT o_custkey), 6) AS fan_out, count(*) / count(DISTINCT o_custkey) <= 1.02 AS is_unique FROM orders
UNION ALL SELECT 'o_orderkey', count(*), count(DISTINCT o_orderkey), round(count(*) / count(DISTINCT o_orderkey), 6), count(*) / count(DISTINCT o_orderkey) <= 1.02 FROM orders""",
    "orphan_keys": "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)",
    "join_amplification": "WITH j AS (SELECT count(*) AS n FROM orders JOIN events ON o_custkey = user_id) SELECT n AS n_out, round(n / greatest((SELECT count(*) FROM orders), (SELECT count(*) FROM events)), 6) AS amplification FROM j",
    "usage_stats": """
SELECT event_type AS ds, count(*) AS n_reads, count(DISTINCT user_id) AS n_principals, count(DISTINCT CASE WHEN user_id % 10 <> 0 THEN user_id END) AS n_human,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_read, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_read FROM events GROUP BY 1""",
    "never_read": "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')",
    "lifetime_cost": """
SELECT l_suppkey, count(*) AS runs, sum(l_quantity::BIGINT)::BIGINT AS units, round(count(*) * 0.25::DOUBLE + sum(l_quantity::BIGINT) * 0.01::DOUBLE, 6) AS spend,
  round((count(*) * 0.25::DOUBLE + sum(l_quantity::BIGINT) * 0.01::DOUBLE) / count(*), 6) AS per_run, (max(l_shipdate)::DATE - min(l_shipdate)::DATE)::BIGINT AS days FROM lineitem GROUP BY 1""",
    "billing_by_period": f"""
SELECT {_MONTH} AS period, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, count(DISTINCT o_orderdate::DATE) AS n_days,
  sum(CASE WHEN o_orderpriority <> '5-LOW' THEN round(o_totalprice * 100)::BIGINT ELSE 0 END)::BIGINT AS attributed FROM orders GROUP BY 1""",
    "billing_reconcile": """
WITH b AS (SELECT year(o_orderdate) AS y, sum(round(o_totalprice)::BIGINT)::BIGINT AS billed, count(DISTINCT o_orderdate::DATE) AS days FROM orders GROUP BY 1),
m AS (SELECT year(o_orderdate) AS y, count(*) * 1000 AS modelled FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT y AS year, billed, modelled, round(billed / modelled, 6) AS correction, days >= 14 AS reliable FROM b LEFT JOIN m USING (y)""",
    "quality_suite_check": """
WITH c AS (SELECT count(*) FILTER (NOT o_totalprice > 0) AS a, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS b, count(*) FILTER (o_orderpriority = '1-URGENT' AND NOT o_totalprice > 50000) AS c,
  count(*) FILTER (NOT o_orderdate BETWEEN '1995-01-01' AND '2000-12-31') AS d FROM orders)
SELECT rule, n_failed, n_failed = 0 AS passed FROM (SELECT unnest(['price_positive', 'status_known', 'urgent_is_large', 'date_in_range']) AS rule, unnest([a, b, c, d]) AS n_failed FROM c)""",
    "learned_bounds": "SELECT l_returnflag, round(min(l_quantity) - (max(l_quantity) - min(l_quantity)) * 0.1::DOUBLE, 6) AS low, round(max(l_quantity) + (max(l_quantity) - min(l_quantity)) * 0.1::DOUBLE, 6) AS high FROM lineitem GROUP BY 1",
    "incident_groups": """
WITH e AS (SELECT DISTINCT user_id % 5 AS service, date_trunc('hour', ts)::TIMESTAMP AS "at" FROM events WHERE event_type = 'error'),
i AS (SELECT *, "at" - to_hours(CAST(row_number() OVER (PARTITION BY service ORDER BY "at") AS INTEGER)) AS island FROM e)
SELECT service, strftime(min("at"), '%Y-%m-%d %H:%M:%S') AS incident, count(*) AS n FROM i GROUP BY service, island""",
    "mttd_mttr": """
WITH e AS (SELECT user_id, ts::DATE AS d, min(CASE WHEN event_type = 'error' THEN floor(epoch(ts))::BIGINT END) AS s, max(floor(epoch(ts))::BIGINT) AS z, min(CASE WHEN event_type = 'click' THEN floor(epoch(ts))::BIGINT END) AS f FROM events GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(CASE WHEN f >= s THEN f - s END), 6) AS mttd, round(avg(z - s), 6) AS mttr FROM e WHERE s IS NOT NULL""",
    "freshness_offenders": """
WITH g AS (SELECT o_custkey, (DATE '2001-08-02' - max(o_orderdate)::DATE)::BIGINT AS age, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, age, age * greatest(1, n) AS score FROM g ORDER BY score DESC, o_custkey LIMIT 10""",
    "histogram_quantile": """
WITH b AS (SELECT u, coalesce(lag(u) OVER (ORDER BY u), 0.0)::DOUBLE AS lo FROM (VALUES (5.0::DOUBLE), (10.0), (20.0), (35.0), (50.0)) v(u)),
c AS (SELECT u, lo, (SELECT count(*) FROM lineitem WHERE l_quantity <= u) AS cum, (SELECT count(*) FROM lineitem WHERE l_quantity <= lo) AS below, (SELECT count(*) FROM lineitem) AS total FROM b)
SELECT q, round(lo + (u - lo) * (q * total - below) / (cum - below), 6) AS value FROM c, (VALUES (0.5::DOUBLE), (0.95)) v(q) WHERE cum >= q * total AND below < q * total""",
    "missed_buckets": """
WITH s AS (SELECT unnest(generate_series(date_trunc('hour', min(ts))::TIMESTAMP, date_trunc('hour', max(ts))::TIMESTAMP, INTERVAL 1 HOUR)) AS h FROM events)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, strftime(h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS until FROM s WHERE h NOT IN (SELECT date_trunc('hour', ts)::TIMESTAMP FROM events WHERE event_type = 'error')""",
}
