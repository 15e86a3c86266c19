"""Change feeds and logs of warehouses and catalogs, in the shape that their own tables have.

Readers of those tables (JDBC, a connector, exported files) are Spark's; these
operators say what changed since a token and what the next token is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.lineage import partition_id_time

# Partition ids that stand for no value and for rows not yet dealt.
NULL_ID, STREAMING_ID = "__NULL__", "__UNPARTITIONED__"
#: Statement kinds of a query log that write tables.
WRITES = ("CREATE_TABLE_AS_SELECT", "INSERT", "MERGE", "UPDATE", "DELETE")


def partition_changes(meta: DataFrame, since: object | None) -> DataFrame:
    """(ds, any, dt, modified) of partitions changed after a time; meta: table_name, partition_id, last_modified_time.

    The null partition has no dt; rows not yet dealt to partitions may be of any.
    """
    rows = meta if since is None else meta.where(F.col("last_modified_time") > F.lit(since).cast(meta.schema["last_modified_time"].dataType))
    dt = F.when(F.col("partition_id").isin(NULL_ID, STREAMING_ID), F.lit(None)).otherwise(partition_id_time(F.col("partition_id")))
    anything = (F.col("partition_id") == STREAMING_ID) | (dt.isNull() & (F.col("partition_id") != NULL_ID))
    return rows.select(F.col("table_name").alias("ds"), anything.alias("any"), dt.alias("dt"), F.col("last_modified_time").alias("modified"))


def altered(tables: DataFrame, tokens: DataFrame) -> DataFrame:
    """(ds, token): tables altered since their token, wholly stale; tables: ds, last_altered; tokens: ds, token. Texts are compared, as catalogs give them."""
    return tables.join(tokens, "ds", "left").where(F.col("token").isNull() | (F.col("last_altered") > F.col("token"))).select("ds", F.col("last_altered").alias("token"))


def located_changes(details: DataFrame, changes: DataFrame) -> DataFrame:
    """(ds, partition) of tables by the location their catalog names; changes: location, partition."""
    slash = lambda c: F.regexp_replace(c, "/+$", "")
    return details.select("ds", slash(F.col("location")).alias("location")).join(changes.select(slash(F.col("location")).alias("location"), "partition"), "location").select("ds", "partition").distinct()


def statements_since(log: DataFrame, since: object, most: int = 100_000) -> DataFrame:
    """Successful writing statements after a token, oldest first, at most `most` a pull; log: query_id, query_text, query_type, execution_status, start_time."""
    rows = log.where((F.col("start_time") > F.lit(since).cast(log.schema["start_time"].dataType)) & (F.col("execution_status") == "SUCCESS") & F.col("query_type").isin(*WRITES))
    return rows.orderBy("start_time", "query_id").limit(most)


def held_back(observed: Column, hours: int) -> Column:
    """The token of a log whose rows arrive up to some hours late: the newest time seen, less those hours."""
    return F.max(observed) - F.make_dt_interval(hours=F.lit(hours))


def engine_edges(native: DataFrame, parsed: DataFrame) -> DataFrame:
    """(dst, src, from_log): a table's edges from the engine's own lineage, else from its parsed statements."""
    a, b = native.select("dst", "src").distinct(), parsed.select("dst", "src").distinct()
    return a.withColumn("from_log", F.lit(False)).unionByName(b.join(a.select("dst").distinct(), "dst", "left_anti").withColumn("from_log", F.lit(True)))


def changed_objects(files: DataFrame, token: DataFrame) -> DataFrame:
    """Files modified since a token; files: path, etag, modified; token: t and the etags seen at t, one row each (none yet: no rows).

    Times are coarse, so files at the token's own time count unless their etag
    was seen; a file without a time always counts.
    """
    cut = token.agg(F.max("t").alias("t"))  # one row
    seen = token.where("etag is not null").select("etag", F.lit(True).alias("_seen")).distinct()
    rows = files.crossJoin(cut).join(seen, "etag", "left")
    return rows.where(F.col("modified").isNull() | F.col("t").isNull() | ((F.col("modified") >= F.col("t")) & F.col("_seen").isNull())).select(*files.columns)


def next_token(files: DataFrame, token: DataFrame) -> DataFrame:
    """(t, etag): the newest time seen and the etags of the files at it."""
    high = files.agg(F.max("modified").alias("a")).crossJoin(token.agg(F.max("t").alias("b"))).select(F.greatest("a", "b").alias("t")).where("t is not null")  # one row each
    at = files.select("etag", "modified").where("etag is not null").distinct()
    return high.join(at, F.col("modified") == F.col("t"), "left").select("t", "etag")
