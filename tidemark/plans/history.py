"""The history of a graph: revisions that are appended if nobody was faster, and the graph as of any moment.

A folder holds one small file for each revision and the changes it made as
Parquet. A revision is written by putting its file if it is absent, so of two
writers with one parent the second is refused; its changes are then never read.
Edges carry the range of revisions in which they held, so the graph at many
moments is one range join.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_REVISION = "number long, at timestamp, author string, note string, parent string, digest string, changes string, added long, removed long, changed long"
_CHANGE = "src string, dst string, value string, change string"


class StaleParent(ValueError):
    """What was to be recorded was made from another graph than the newest."""


def digest(edges: DataFrame) -> str:
    """A graph's digest, whatever the order of its edges: src, dst, value."""
    sums = edges.select("src", "dst", "value").distinct().agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.xxhash64(F.lit(s), "src", "dst", "value").cast("decimal(38,0)")), F.lit(0)).alias(f"s{s}") for s in (1, 2)]).first()
    return f"{sums['n']}:{sums['s1']}:{sums['s2']}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with a text; False if it is there. The whole text is moved into place at once."""
    target, fs = _fs(spark, path)
    draft, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    jvm = spark.sparkContext._jvm
    try:
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        names = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        names[0] = none
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, names)
        return True
    except Exception as e:  # noqa: BLE001 - py4j wraps what the file system says
        if not fs.exists(target):
            raise e
        fs.delete(draft, False)
        return False


def revisions(spark: SparkSession, path: str) -> DataFrame:
    """(number, at, author, note, parent, digest, changes, added, removed, changed) of every revision."""
    folder, fs = _fs(spark, f"{path}/revisions")
    if not fs.exists(folder):
        return spark.createDataFrame([], _REVISION)
    return spark.read.schema(_REVISION).option("pathGlobFilter", "*.json").json(f"{path}/revisions")


def head(spark: SparkSession, path: str) -> dict | None:
    row = revisions(spark, path).orderBy(F.desc("number")).first()
    return row.asDict() if row else None


def _changes(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, value, change, number) of every revision."""
    made = revisions(spark, path).select("number", "changes")
    folder, fs = _fs(spark, f"{path}/changes")
    if not fs.exists(folder):
        return spark.createDataFrame([], f"{_CHANGE}, number long")
    rows = spark.read.schema(f"{_CHANGE}, batch string").option("basePath", f"{path}/changes").parquet(f"{path}/changes")
    return rows.join(made.withColumnRenamed("changes", "batch"), "batch").select("src", "dst", "value", "change", "number")


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, value, since, until): the revisions from `since` to before `until` (null: still) in which an edge held with a value."""
    w = W.partitionBy("src", "dst").orderBy("number")
    return _changes(spark, path).withColumn("until", F.lead("number").over(w)).where("change <> 'removed'").select("src", "dst", "value", F.col("number").alias("since"), "until")


def as_of(spark: SparkSession, path: str, moments: DataFrame) -> DataFrame:
    """(at, src, dst, value) of the graph at each moment (column `at`): what the newest revision until then held."""
    w = W.orderBy("number")  # revisions are few
    known = revisions(spark, path).select("number", F.col("at").alias("begun"), F.lead("at").over(w).alias("ended"))
    when = moments.select("at").distinct().join(known, (F.col("at") >= F.col("begun")) & (F.col("ended").isNull() | (F.col("at") < F.col("ended")))).select("at", "number")
    held = intervals(spark, path)
    return held.join(when, (F.col("number") >= F.col("since")) & (F.col("until").isNull() | (F.col("number") < F.col("until")))).select("at", "src", "dst", "value")


def graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, value) now."""
    return intervals(spark, path).where("until is null").select("src", "dst", "value")


def record(spark: SparkSession, path: str, edges: DataFrame, at: str, author: str = "", note: str = "", parent: str | None = None) -> dict:
    """Append a graph (src, dst, value; one value an edge) as a revision; an unchanged one gives the newest revision back.

    `parent` is the digest of the graph that this one was made from; it may be left out for the first.
    """
    new = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("value").cast("string").alias("value")).distinct()
    mark, last = digest(new), head(spark, path)
    if last and last["digest"] == mark:
        return last
    if last and parent != last["digest"]:
        raise StaleParent(f"made from {parent}, but the newest revision {last['number']} is {last['digest']}")
    old = graph(spark, path).select("src", "dst", F.col("value").alias("had"), F.lit(True).alias("_old"))
    both = new.withColumn("_new", F.lit(True)).join(old, ["src", "dst"], "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("value").eqNullSafe(F.col("had")), "changed")
    batch, number = uuid.uuid4().hex, (last["number"] + 1 if last else 0)
    both.select("src", "dst", "value", change.alias("change")).where("change is not null").write.parquet(f"{path}/changes/batch={batch}")
    counts = {r["change"]: r["count"] for r in spark.read.schema(_CHANGE).parquet(f"{path}/changes/batch={batch}").groupBy("change").count().collect()}
    row = {"number": number, "at": at, "author": author, "note": note, "parent": last["digest"] if last else None, "digest": mark, "changes": batch, "added": counts.get("added", 0), "removed": counts.get("removed", 0), "changed": counts.get("changed", 0)}
    if not _put_if_absent(spark, f"{path}/revisions/{number:020}.json", json.dumps(row)):
        raise StaleParent(f"revision {number} was written by someone else meanwhile")
    return row


def unsafe(spark: SparkSession, path: str) -> DataFrame:
    """(number, removed, changed) of revisions that took an edge away or gave it another mapping: what is stale may be less since."""
    return revisions(spark, path).where("removed > 0 or changed > 0").select("number", "removed", "changed")
