"""Attribution, agents, contexts, contracts, approvals, replicas and graph health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import reach

# Weights of a suspect's score, of graph health, and severities.
SEVERITY = {"error": 1.0, "warn": 0.7, "info": 0.3}
WEIGHTS = (0.6, 0.3, 0.1)
HEALTH = (0.3, 0.3, 0.2, 0.2)
#: Votes that one task takes, about.
VOTES = 500_000


def severity(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, value in SEVERITY.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def attribute(edges: DataFrame, target: DataFrame, findings: DataFrame, max_depth: int = 6) -> DataFrame:
    """(node, hops, score): ancestors of a target by how bad and how near their findings are.

    findings: node, severity, on_column (whether the finding is on the column asked about).
    """
    above = reach(edges, target, max_depth, upstream=True).groupBy("node").agg(F.min("depth").alias("hops"))
    worst = findings.groupBy("node").agg(F.max(severity(F.col("severity"))).alias("s"), F.max(F.col("on_column").cast("int")).alias("c"))
    near = 1 - (F.col("hops") - 1) / F.lit(max_depth)
    return above.join(worst, "node").select("node", "hops", (WEIGHTS[0] * F.col("s") + WEIGHTS[1] * near + WEIGHTS[2] * F.col("c")).alias("score"))


def first_time(run: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """What a run read that no earlier one had."""
    return run.select(*keys).distinct().join(history.select(*keys), keys, "left_anti")


def unused_grants(granted: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    return granted.select(*keys).distinct().join(history.select(*keys), keys, "left_anti")


def exfiltration(calls: DataFrame, sensitive: DataFrame) -> DataFrame:
    """(run, ds, target): runs that read a sensitive dataset and also sent something out.

    calls: run, ds, egress, target. The two sides meet on the run; each is made distinct first.
    """
    read = calls.join(sensitive, "ds", "left_semi").select("run", "ds").distinct()
    sent = calls.where("egress").select("run", "target").distinct()
    return read.join(sent, "run")


def broken_promises(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, breach) of a contract's columns: gone, of another type, or nullable where they were not."""
    b, a = (x.select("name", F.col("dtype").alias(f"{p}_t"), F.col("nullable").alias(f"{p}_n")) for x, p in ((before, "b"), (after, "a")))
    breach = F.when(F.col("a_t").isNull(), "removed").when(F.col("a_t") != F.col("b_t"), "retyped").when(F.col("a_n") & ~F.col("b_n"), "nullable")
    return b.join(a, "name", "left").select("name", breach.alias("breach")).where("breach is not null")


def approved(requests: DataFrame, votes: DataFrame, needed: int) -> DataFrame:
    """(request, state): any rejection refuses; approvals count once for each approver, never the author's.

    Both sides are parted by request once, into as many parts as the votes need: what a task holds doesn't grow with them.
    """
    n = max(votes.count() // VOTES + 1, requests.sparkSession.sparkContext.defaultParallelism)
    r = requests.select("request", "author").repartition(n, "request")
    v = votes.select("request", "approver", "approve").repartition(n, "request").join(r, "request").where("approver <> author")
    c = v.groupBy("request").agg(F.count_distinct(F.when(F.col("approve"), F.col("approver"))).alias("yes"), F.count_if(~F.col("approve")).alias("no"))
    state = F.when(F.col("no") > 0, "rejected").when(F.col("yes") >= needed, "approved").otherwise("pending")
    return r.join(c, "request", "left").select("request", F.coalesce(state, F.lit("pending")).alias("state"))


def divergent(replicas: DataFrame, key: list[str], fingerprint: str) -> DataFrame:
    """(key, n, versions): partitions whose replicas differ."""
    return replicas.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(fingerprint, F.lit(""))).alias("versions")).where("versions > 1")


def shredded(rows: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """Rows that can no longer be read, as their key was destroyed or never made."""
    return rows.join(keys.where("not destroyed").select(by), by, "left_anti")


def health(edges: DataFrame, specced: DataFrame) -> DataFrame:
    """One row: shares of specced nodes, bounded edges, column-level edges and provable fields, and their weighted score.

    edges: src, dst, bounded, has_columns, fields, proven.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    n = nodes.join(specced.select("node", F.lit(1).alias("_s")), "node", "left").agg(F.avg(F.coalesce("_s", F.lit(0)).cast("double")).alias("specs"))
    e = edges.agg(F.avg(F.col("bounded").cast("double")).alias("bounded"), F.avg(F.col("has_columns").cast("double")).alias("columns"), F.coalesce(F.try_divide(F.sum("proven"), F.sum("fields")), F.lit(0.0)).alias("proven"))
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("specs", "bounded", "columns", "proven")]
    score = sum((w * p for w, p in zip(HEALTH, parts, strict=True)), F.lit(0.0))
    return n.crossJoin(e).select(*[p.alias(c) for p, c in zip(parts, ("specs", "bounded", "columns", "proven"), strict=True)], score.alias("score"))  # one row each


def wasted_context(retrieved: DataFrame, cited: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """(first key, wasted, tokens): tokens of retrieved chunks that an answer does not cite."""
    used = cited.select(*keys).distinct().withColumn("_u", F.lit(1))
    return retrieved.join(used, keys, "left").groupBy(keys[0]).agg(F.sum(F.when(F.col("_u").isNull(), F.col(tokens)).otherwise(0)).alias("wasted"), F.sum(tokens).alias("tokens"))


def kind_of(uri: Column) -> Column:
    """The kind of asset that a URI's scheme names; a table if it has none."""
    scheme = F.regexp_extract(uri, r"^([a-z][a-z0-9_+.-]*)://", 1)
    known = "model checkpoint adapter feature_view embedding_space vector_index prompt eval_set corpus agent tool run sweep tokenizer mixture".split()
    return F.when(F.regexp_replace(scheme, "-", "_").isin(known), F.regexp_replace(scheme, "-", "_")).otherwise("table")
