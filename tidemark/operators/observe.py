"""Profiles, drift, completeness, seasonality, joins, usage and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.time import cycle_bucket, step
from tidemark.operators.components import connected_components

# Fixed values of the checks.
ROW_CHANGE, NULL_CHANGE, FEW_ROWS = 0.25, 0.05, 1000
UNIQUE_FAN_OUT = 1.02
LEAST_OBSERVATIONS = 4
SCHEDULERS = r"(airflow|dagster|dbt|svc_|service_|-job|_job|system)"


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(name, dtype, row_count, null_count, min, max, distinct): one scan for all columns.

    Exact distinct counts shuffle each column's values; `approximate` keeps the whole profile map-side.
    """
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"c{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"), distinct(c).alias(f"d{i}")]
    rows = [F.struct(F.lit(c).alias("name"), F.lit(kinds[c]).alias("dtype"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"c{i}")).alias("null_count"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def profile_by(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The profile of one column in each partition."""
    return df.groupBy(*by).agg(F.count("*").alias("row_count"), (F.count("*") - F.count(column)).alias("null_count"), F.min(column).alias("min"), F.max(column).alias("max"), F.approx_count_distinct(column).alias("distinct"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, kind, severity) of what changed between two profiles (numeric min and max).

    Findings on fewer than FEW_ROWS rows are informative only; a column that
    went or changed type is an error at any size; a widening range is no drift.
    """
    cols = ["dtype", "row_count", "null_count", "min", "max"]
    b = before.select("name", *[F.col(c).alias(f"b_{c}") for c in cols])
    a = after.select("name", *[F.col(c).alias(f"a_{c}") for c in cols])
    rate = lambda s: F.when(F.col(f"{s}_row_count") > 0, F.col(f"{s}_null_count") / F.col(f"{s}_row_count"))
    few = F.least("b_row_count", "a_row_count") < FEW_ROWS
    soft = F.when(few, F.lit("info")).otherwise(F.lit("warn"))
    number = lambda c: F.col(c).try_cast("double")
    grown = F.when(F.col("b_row_count") > 0, F.abs(F.col("a_row_count") / F.col("b_row_count") - 1) > ROW_CHANGE).otherwise((F.col("b_row_count") == 0) & (F.col("a_row_count") > 0))
    checks = [
        ("column_removed", F.col("a_dtype").isNull(), F.lit("error")), ("column_added", F.col("b_dtype").isNull(), F.lit("info")),
        ("type_changed", F.col("a_dtype") != F.col("b_dtype"), F.lit("error")), ("row_count", grown, soft),
        ("null_rate", F.abs(rate("a") - rate("b")) > NULL_CHANGE, soft), ("min_raised", number("a_min") > number("b_min"), F.lit("info")), ("max_lowered", number("a_max") < number("b_max"), F.lit("info")),
    ]
    found = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), severity.alias("severity"))) for kind, when, severity in checks])
    return b.join(a, "name", "full_outer").select("name", F.inline(F.filter(found, lambda x: x.isNotNull())))


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change, before, after) of two (name, dtype) tables."""
    both = before.select("name", F.col("dtype").alias("before")).join(after.select("name", F.col("dtype").alias("after")), "name", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("retyped")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("name", change.alias("change"), "before", "after")


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def gap_runs(present: DataFrame, by: list[str], bucket: str, grain: str) -> DataFrame:
    """(by, first, last, n): runs of missing buckets between the first and last present of each slice.

    A gap is a pair of neighbours more than one grain apart: one window pass, no calendar is spelled out.
    """
    w = W.partitionBy(*by).orderBy(bucket)
    rows = present.select(*by, bucket).distinct().withColumn("next", F.lead(bucket).over(w)).where(F.col("next") > step(bucket, 1, grain))
    first, last = step(bucket, 1, grain), step("next", -1, grain)
    size = {"hour": lambda: F.timestamp_diff("HOUR", F.col(bucket), F.col("next")), "day": lambda: F.date_diff("next", bucket), "month": lambda: F.months_between("next", bucket).cast("int"), "year": lambda: F.year("next") - F.year(bucket)}[grain]() - 1
    return rows.select(*by, first.alias("first"), last.alias("last"), size.cast("long").alias("n"))


def completeness(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected, missing, unexpected, ratio (1 if nothing was expected)."""
    e, p = expected.select(*keys).distinct().withColumn("e", F.lit(1)), present.select(*keys).distinct().withColumn("p", F.lit(1))
    c = e.join(p, keys, "full_outer").agg(F.count("e").alias("expected"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))
    return c.withColumn("ratio", F.when(F.col("expected") == 0, 1.0).otherwise(1 - F.col("missing") / F.col("expected")))


def repeats(arrivals: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, n, kind): partitions that arrived more than once; a replay if all copies are one known digest, else a restatement."""
    g = arrivals.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(digest).alias("d"), F.max((F.coalesce(digest, F.lit("")) == "").cast("int")).alias("blank")).where("n > 1")
    return g.select(*keys, "n", F.when((F.col("d") == 1) & (F.col("blank") == 0), "replay").otherwise("restatement").alias("kind"))


def seasonal_bands(history: DataFrame, ts: str, metric: str, cycle: str, margin: float = 0.1) -> DataFrame:
    """(bucket, n, low, high): padded range of a metric at each place of a cycle, from four observations up."""
    g = history.groupBy(cycle_bucket(ts, cycle).alias("bucket")).agg(F.count("*").alias("n"), F.min(metric).alias("lo"), F.max(metric).alias("hi")).where(F.col("n") >= LEAST_OBSERVATIONS)
    pad = F.greatest((F.col("hi") - F.col("lo")) * margin, F.abs("hi") * margin, F.lit(1e-9))
    return g.select("bucket", "n", (F.col("lo") - pad).alias("low"), (F.col("hi") + pad).alias("high"))


def seasonal_violations(rows: DataFrame, bands: DataFrame, ts: str, metric: str, cycle: str) -> DataFrame:
    return rows.withColumn("bucket", cycle_bucket(ts, cycle)).join(bands, "bucket").where((F.col(metric) < F.col("low")) | (F.col(metric) > F.col("high")))


def cycle_strength(history: DataFrame, ts: str, metric: str, cycle: str) -> DataFrame:
    """One row: share of the variance that the place in the cycle explains; null for under two buckets, three points or no variance."""
    g = history.groupBy(cycle_bucket(ts, cycle).alias("bucket")).agg(F.count(metric).alias("n"), F.sum(F.col(metric).cast("double")).alias("s"), F.sum(F.col(metric).cast("double") * F.col(metric)).alias("q"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    whole, between = F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("b") - F.col("s") * F.col("s") / F.col("n")
    return t.select(F.when((F.col("k") >= 2) & (F.col("n") >= 3) & (whole > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), between / whole))).alias("strength"))


def key_shape(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, distinct, fan_out, is_unique."""
    g = df.agg(F.count("*").alias("n_rows"), F.count_distinct(column).alias("n_distinct"))
    fan = F.when(F.col("n_distinct") > 0, F.col("n_rows") / F.col("n_distinct"))
    return g.select("n_rows", "n_distinct", fan.alias("fan_out"), F.coalesce((fan > 0) & (fan <= UNIQUE_FAN_OUT), F.lit(False)).alias("is_unique"))


def orphans(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Keys of the left side that the right lacks."""
    return left.select(F.col(key).alias("key")).distinct().join(right.select(F.col(other).alias("key")), "key", "left_anti")


def amplification(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """One row: rows out of a join over the larger input, from counts per key alone."""
    a, b = left.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("a")), right.groupBy(F.col(other).alias("k")).agg(F.count("*").alias("b"))
    g = a.join(b, "k", "full_outer").agg(F.sum(F.col("a") * F.col("b")).alias("n_out"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return g.select(F.coalesce("n_out", F.lit(0)).alias("n_out"), (F.coalesce("n_out", F.lit(0)) / F.greatest("na", "nb")).alias("amplification"))


def usage(reads: DataFrame, ds: str, who: str, at: str) -> DataFrame:
    """(ds, n_reads, n_principals, n_human, first_read, last_read)."""
    human = F.when(~F.col(who).cast("string").rlike(SCHEDULERS), F.col(who))
    return reads.groupBy(F.col(ds).alias("ds")).agg(F.count("*").alias("n_reads"), F.count_distinct(who).alias("n_principals"), F.count_distinct(human).alias("n_human"), F.min(at).alias("first_read"), F.max(at).alias("last_read"))


def incident_groups(findings: DataFrame, window_seconds: int, key: str, at: str) -> DataFrame:
    """(key, at, incident): findings of one key within a window of each other, chained; incident is the first one's time.

    Gaps of the sorted times, so a key's findings are never paired.
    """
    w = W.partitionBy(key).orderBy(at)
    gap = F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(w).cast("timestamp"))
    begun = findings.withColumn("_new", F.when(gap.isNull() | (gap > window_seconds), F.col(at)))
    return begun.withColumn("incident", F.last("_new", ignorenulls=True).over(w)).drop("_new")


def linked_incidents(findings: DataFrame, related: DataFrame, node: str) -> DataFrame:
    """(node, component): findings whose datasets are joined by lineage, merged whatever the order."""
    return connected_components(related.join(findings.select(F.col(node).alias("src")).distinct(), "src", "left_semi").join(findings.select(F.col(node).alias("dst")).distinct(), "dst", "left_semi"), "src", "dst")


def suite(df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """(rule, n_failed, passed) of row rules in one scan; each is (name, rows that it looks at, what must hold)."""
    aggs = [F.count_if(where & ~F.coalesce(holds, F.lit(False))).alias(f"r{i}") for i, (_, where, holds) in enumerate(rules)]
    rows = [F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n_failed"), (F.col(f"r{i}") == 0).alias("passed")) for i, (n, _, _) in enumerate(rules)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def learn_bounds(history: DataFrame, by: list[str], metric: str, margin: float = 0.1) -> DataFrame:
    """(by, low, high): the range seen, widened by a share of it; what later rows are held against."""
    g = history.groupBy(*by).agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    pad = (F.col("hi") - F.col("lo")) * margin
    return g.select(*by, (F.col("lo") - pad).alias("low"), (F.col("hi") + pad).alias("high"))


def quantile_from_buckets(counts: DataFrame, upper: str, n: str, q: float) -> DataFrame:
    """One row: a quantile by linear interpolation in cumulative buckets; null above the last finite bound."""
    w = W.orderBy(F.col(upper).asc_nulls_last())
    c = counts.withColumn("cum", F.sum(n).over(w)).withColumn("below", F.coalesce(F.lag("cum").over(w), F.lit(0))).withColumn("lower", F.coalesce(F.lag(upper).over(w), F.lit(0.0)))
    total = c.agg(F.max("cum").alias("total"))
    hit = c.crossJoin(total).where((F.col("cum") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    return hit.select((F.col("lower") + (F.col(upper) - F.col("lower")) * (q * F.col("total") - F.col("below")) / (F.col("cum") - F.col("below"))).alias("value"))


def span_times(spans: DataFrame) -> DataFrame:
    """(span, parent, seconds, self_seconds, n_children): a span's seconds less those of its children, never below none; spans: span, parent, seconds."""
    below = spans.where("parent is not null").groupBy(F.col("parent").alias("span")).agg(F.sum("seconds").alias("inner"), F.count("*").alias("n_children"))
    own = F.greatest(F.lit(0.0), F.col("seconds") - F.coalesce("inner", F.lit(0.0)))
    return spans.join(below, "span", "left").select("span", "parent", "seconds", own.alias("self_seconds"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))
