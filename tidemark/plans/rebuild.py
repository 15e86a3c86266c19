"""Rebuilding stale partitions, and proof that nothing stale was missed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import step


def predicate(keys: list[dict], grains: dict[str, str]) -> Column:
    """The rows of any of the keys: half-open ranges for times, so filters reach the scan.

    A field that a key lacks is unconstrained, None is the null partition; a key
    without fields, or no keys at all, is everything.
    """
    if not keys or any(not k for k in keys):
        return F.lit(True)

    def one(name: str, value: object) -> Column:
        c = F.col(name)
        if value is None:
            return c.isNull()
        if name not in grains:
            return c == F.lit(value)
        start = F.lit(value).cast("timestamp_ntz")
        return (c >= start) & (c < step(start, 1, grains[name]))

    distinct = {tuple(sorted(k.items(), key=lambda x: x[0])) for k in keys}
    return reduce(Column.__or__, [reduce(Column.__and__, [one(n, v) for n, v in k]) for k in sorted(distinct, key=str)])


def row_text(columns: list[str]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def fingerprints(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Exact digest of each partition's rows as a multiset; one string per partition, so for small ones."""
    return df.select(*by, row_text(columns).alias("_row")).groupBy(*by).agg(F.count("*").alias("n_rows"), F.expr("md5(listagg(_row, chr(30)) within group (order by _row))").alias("fp"))


def digest_sums(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Digest of any size of partition: the count and the sum of 60-bit row hashes, which pre-aggregate before the shuffle."""
    h = F.conv(F.left(F.md5(row_text(columns)), F.lit(15)), 16, 10).cast("decimal(20,0)")
    return df.select(*by, h.alias("_h")).groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum("_h").cast("string").alias("fp"))


def touched(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Partitions whose fingerprint changed, appeared or went."""
    b, a = before.select(*by, F.col("fp").alias("b_fp")), after.select(*by, F.col("fp").alias("a_fp"))
    both = b.join(a, by, "full_outer").where(~F.col("b_fp").eqNullSafe(F.col("a_fp")))
    kind = F.when(F.col("b_fp").isNull(), F.lit("new")).when(F.col("a_fp").isNull(), F.lit("gone")).otherwise(F.lit("changed"))
    return both.select(*by, kind.alias("change"))


def shadow(planned: DataFrame, touched_keys: DataFrame, total: DataFrame, by: list[str]) -> DataFrame:
    """One row: planned, touched, missed (must be 0), wasted, savings, precision."""
    p, t = planned.select(*by).distinct(), touched_keys.select(*by).distinct()
    flags = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), by, "full_outer")
    counts = flags.agg(F.count("p").alias("planned"), F.count("t").alias("touched"), F.count_if(F.col("p").isNull()).alias("missed"), F.count_if(F.col("t").isNull()).alias("wasted"))
    every = total.select(*by).distinct().agg(F.count("*").alias("total"))
    out = counts.crossJoin(every)  # one row each
    savings = F.when(F.col("total") > 0, F.greatest(F.lit(0.0), 1 - F.col("planned") / F.col("total"))).otherwise(F.lit(0.0))
    precision = F.when(F.col("planned") > 0, 1 - F.col("wasted") / F.col("planned")).otherwise(F.lit(1.0))
    return out.select("planned", "touched", "missed", "wasted", "total", savings.alias("savings"), precision.alias("precision"))


def overwrite_partitions(result: DataFrame, planned: DataFrame, path: str, by: list[str]) -> list[dict]:
    """Write `result` over its partitions at `path`; returns planned partitions that came out empty, whose folders go.

    Dynamic overwrite leaves alone what it does not write, so emptied partitions
    are removed by hand.
    """
    spark = result.sparkSession
    result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    empty = [r.asDict() for r in planned.select(*by).distinct().join(result.select(*by).distinct(), by, "left_anti").collect()]
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in empty:
        folder = "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if row[c] is None else row[c]}" for c in by)
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, folder), True)
    return empty


def erase(df: DataFrame, column: str, subject: object, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes) of one subject's rows; `where` may narrow the partitions but never be absent by accident."""
    if column not in df.columns:
        raise ValueError(f"no column {column}: nothing is erased")
    goes = F.col(column).eqNullSafe(F.lit(subject)) & F.coalesce(where if where is not None else F.lit(True), F.lit(False))
    return df.where(~goes), df.where(goes)
