"""Change feeds, logs, statement lineage, stored state, spans and texts that are compared one by one."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import ml, observe
from tidemark.plans import store
from tidemark.plans.naming import parse_spec
from tidemark.session import shared_dir
from tidemark.sources import dbt, delta, feeds, iceberg, registered, sqllineage
from tidemark.suites import day, digits, long, minute, table

#: Statements of a log, and what each says: its target, (source, its column, target's column) and (source, field, form, source's field, grain, lo, hi). {c} is the number of a shop.
_ANY = ("any", None, None, 0, 0)
FORMS = (
    ("INSERT INTO gold.monthly_{c} SELECT date_trunc('month', dt) AS dt, region, sum(amount) AS revenue FROM silver.events_{c} GROUP BY 1, 2", "gold.monthly_{c}",
     (("silver.events_{c}", "dt", "dt"), ("silver.events_{c}", "region", "region"), ("silver.events_{c}", "amount", "revenue")),
     (("silver.events_{c}", "dt", "window", "dt", "month", 0, 0), ("silver.events_{c}", "region", "same", "region", None, 0, 0))),
    ("CREATE TABLE silver.events_{c} AS WITH x AS (SELECT * FROM raw.events_{c}) SELECT x.dt, x.region, x.amount * u.rate AS amount, x.id FROM x JOIN raw.users u ON x.id = u.id", "silver.events_{c}",
     (("raw.events_{c}", "dt", "dt"), ("raw.events_{c}", "region", "region"), ("raw.events_{c}", "amount", "amount"), ("raw.users", "rate", "amount"), ("raw.events_{c}", "id", "id")),
     (("raw.events_{c}", "dt", "window", "dt", "day", 0, 0), ("raw.events_{c}", "region", "same", "region", None, 0, 0), ("raw.users", "dt", *_ANY), ("raw.users", "region", *_ANY))),
    ("MERGE INTO gold.users t USING silver.users s ON t.id = s.id WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *", "gold.users", (("silver.users", None, None),), (("silver.users", "id", *_ANY),)),
    ("INSERT INTO gold.yearly_{c} SELECT date_trunc('year', dt) AS dt, revenue FROM gold.monthly_{c}", "gold.yearly_{c}",
     (("gold.monthly_{c}", "dt", "dt"), ("gold.monthly_{c}", "revenue", "revenue")), (("gold.monthly_{c}", "dt", "window", "dt", "year", 0, 0),)),
    ("INSERT INTO gold.joined_{c} SELECT m.dt, m.region, y.revenue FROM gold.monthly_{c} m JOIN gold.yearly_{c} y ON m.dt = y.dt", "gold.joined_{c}",
     (("gold.monthly_{c}", "dt", "dt"), ("gold.monthly_{c}", "region", "region"), ("gold.yearly_{c}", "revenue", "revenue")),
     (("gold.monthly_{c}", "dt", "window", "dt", "month", 0, 0), ("gold.monthly_{c}", "region", "same", "region", None, 0, 0), ("gold.yearly_{c}", "dt", *_ANY), ("gold.yearly_{c}", "region", *_ANY))),
    ("INSERT INTO gold.odd_{c} SELECT dt, region FROM silver.events_{c} UNION ALL SELECT date_add(dt, 7), upper(region) FROM silver.events_{c}", "gold.odd_{c}",
     (("silver.events_{c}", "dt", "dt"), ("silver.events_{c}", "region", "region")), (("silver.events_{c}", "dt", "window", "dt", "day", 0, 7), ("silver.events_{c}", "region", *_ANY))),
    ("INSERT INTO gold.week_{c} SELECT dt, sum(amount) OVER (ORDER BY dt RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS amount FROM silver.events_{c}", "gold.week_{c}",
     (("silver.events_{c}", "dt", "dt"), ("silver.events_{c}", "amount", "amount"), ("silver.events_{c}", "dt", "amount")), (("silver.events_{c}", "dt", "window", "dt", "day", 0, 6),)),
    ("WITH q AS (SELECT date_sub(dt, 1) AS day, amount FROM silver.events_{c}) INSERT INTO gold.week_{c} SELECT day, amount FROM q WHERE amount > (SELECT avg(amount) FROM q)", "gold.week_{c}",
     (("silver.events_{c}", "dt", "dt"), ("silver.events_{c}", "amount", "amount")), (("silver.events_{c}", "dt", *_ANY),)),
    ("INSERT INTO gold.odd_{c} SELECT a.dt, b.region FROM silver.events_{c} a JOIN silver.events_{c} b ON a.id = b.id", "gold.odd_{c}",
     (("silver.events_{c}", "dt", "dt"), ("silver.events_{c}", "region", "region")), (("silver.events_{c}", "dt", *_ANY), ("silver.events_{c}", "region", *_ANY))),
    ("INSERT INTO gold.early_{c} (region, dt) SELECT region, add_months(dt, -1) FROM silver.events_{c}", "gold.early_{c}",
     (("silver.events_{c}", "region", "region"), ("silver.events_{c}", "dt", "dt")), (("silver.events_{c}", "dt", "window", "dt", "month", -2, 0), ("silver.events_{c}", "region", "same", "region", None, 0, 0))),
    ("SELEC nonsense", None, (), ()),
    ("SELECT 1", None, (), ()),
)
SHOPS = 4
#: Columns of the log's tables, in order, and their partition fields.
TABLES = {
    "silver.events_{c}": ("dt date, region string, amount double, id bigint", "dt:day, region"), "raw.events_{c}": ("dt timestamp, region string, amount double, id bigint", "dt:hour, region"), "raw.users": ("id bigint, rate double", ""), "silver.users": ("id bigint", "id"),
    "gold.users": ("id bigint", "id"), "gold.monthly_{c}": ("dt date, region string, revenue double", "dt:month, region"), "gold.yearly_{c}": ("dt date, revenue double", "dt:year"), "gold.joined_{c}": ("dt date, region string, revenue double", "dt:month, region"),
    "gold.odd_{c}": ("dt date, region string", "dt:day, region"), "gold.week_{c}": ("dt date, amount double", "dt:day"), "gold.early_{c}": ("dt date, region string", "dt:month, region"),
}


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Every order ran one of the statements for the shop of its customer."""
    form = F.get(F.array(*[F.lit(f[0]) for f in FORMS]), (F.col("o_orderkey") % len(FORMS)).cast("int"))
    return table(spark, sf, "orders").select(F.replace(form, F.lit("{c}"), (F.col("o_custkey") % SHOPS).cast("string")).alias("sql"))


def _statements(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log's statements with their runs, and their lineage."""
    named = lambda k: {name.replace("{c}", str(c)): x[k] for name, x in TABLES.items() for c in range(SHOPS)}
    schemas = {n: tuple(tuple(c.split()) for c in x.split(", ")) for n, x in named(0).items()}
    log = _log(spark, sf)
    return log.groupBy(F.col("sql").alias("statement")).agg(F.count("*").alias("n_runs")), *sqllineage.log_lineage(log, {n: parse_spec(x) for n, x in named(1).items()}, schemas)


def sql_column_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns the statements of a log make of which, and how often."""
    runs, edges, _ = _statements(spark, sf)
    return edges.join(runs, "statement").groupBy("dst", "src", "src_col", "dst_col").agg(F.sum("n_runs").alias("n_runs"))


def sql_partition_reach(spark: SparkSession, sf: str) -> DataFrame:
    """How partitions of each table reach those of the next, by every statement of a log."""
    return sqllineage.joined(_statements(spark, sf)[2])


def statement_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Which tables the statements of a log write from which."""
    runs, edges, _ = _statements(spark, sf)
    return edges.select("statement", "dst", "src").distinct().join(runs, "statement").groupBy("dst", "src").agg(F.count("*").alias("n_statements"), F.sum("n_runs").alias("n_runs"))


def _write_as(df: DataFrame, path: str, kind: str) -> None:
    """A small table as one file of the given name, as logs have them."""
    folder = f"{path}.tmp"
    (df.coalesce(1).write.json if kind == "json" else df.coalesce(1).write.parquet)(folder)
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(str(x.getPath()) for x in fs.listStatus(p(folder)) if x.getPath().getName().startswith("part-"))
    fs.rename(p(part), p(path))


def delta_table(spark: SparkSession, sf: str) -> str:
    """The folder of a table of the nations' files: commits 0 to 3, a checkpoint of what was live at 1, and an incomplete later one."""
    root = f"{shared_dir(spark)}/tidemark/delta-{uuid.uuid4().hex}"
    log = f"{root}/_delta_log/"
    n = table(spark, sf, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("path"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("partitionValues"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("modificationTime"), F.lit(True).alias("dataChange"), F.col("n_nationkey").alias("k"))
    file = F.struct("path", "partitionValues", "size", "modificationTime", "dataChange")
    add, remove = (lambda df: df.select(file.alias("add"))), (lambda df: df.select(file.alias("remove")))
    _write_as(add(n.where("k < 10")), f"{log}{0:020}.json", "json")
    _write_as(remove(n.where("k < 3")), f"{log}{1:020}.json", "json")
    _write_as(add(n.where("k between 3 and 9")), f"{log}{1:020}.checkpoint.parquet", "parquet")
    _write_as(add(n.where("k >= 20")), f"{log}{2:020}.json", "json")
    _write_as(remove(n.where("k = 5")), f"{log}{3:020}.json", "json")
    _write_as(add(n.where("k = 0")), f"{log}{3:020}.checkpoint.{1:010}.{2:010}.parquet", "parquet")
    return root


def delta_checkpoint_log(spark: SparkSession, sf: str) -> DataFrame:
    return delta.live_files(delta.read_log(spark, delta_table(spark, sf)))


def delta_source(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the source by name."""
    registered.register(spark)
    return delta.live_files(spark.read.format("tidemark_delta").load(delta_table(spark, sf)))


def listed_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Months of orders that a listing by name finds among a table's files, of years after 1996, with the files' sizes known."""
    registered.register(spark)
    path = f"{shared_dir(spark)}/tidemark/listed-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    o.repartition("y", "m").write.partitionBy("y", "m").parquet(path)
    files = spark.read.format("tidemark_listing_pruned").load(path).where("size > 0")
    return files.select(F.col("partition")["y"].cast("int").alias("y"), F.col("partition")["m"].cast("int").alias("m")).where("y > 1996").distinct()


def _entries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each year of orders is a snapshot; its days are manifest entries, and each snapshot carries the one before's forward."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.date_diff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("offset"))
    snaps = o.select("y").distinct().select(F.col("y").alias("snapshot_id"), (F.col("y") * 1000).alias("timestamp_ms"))
    return snaps, o.select(F.col("y").alias("snapshot_id"), F.col("offset").alias("partition")).distinct()


def iceberg_changes(spark: SparkSession, sf: str) -> DataFrame:
    found = iceberg.changed(*_entries(spark, sf), 1999)
    return found.select(day(iceberg.partition_time(F.col("partition"), "day")).alias("dt"), "complete")


def iceberg_expired(spark: SparkSession, sf: str) -> DataFrame:
    """A token whose snapshot is gone: everything, and not complete."""
    return iceberg.changed(*_entries(spark, sf), 7).groupBy("complete").agg(F.count("*").alias("n"))


def iceberg_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets of months, years and hours since 1970."""
    k = F.col("o_orderkey")
    kinds = [minute(iceberg.partition_time(k % m, name)).alias(name) for name, m in (("month", 700), ("year", 60), ("hour", 500_000))]
    return table(spark, sf, "orders").select("o_orderkey", *kinds)


def changed_partition_metadata(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    pid = F.when(k % 5 == 0, F.lit("__NULL__")).when(k % 5 == 1, F.lit("__UNPARTITIONED__")).when(k % 5 == 2, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    meta = table(spark, sf, "orders").select(k.cast("string").alias("table_name"), pid.alias("partition_id"), F.col("o_orderdate").alias("last_modified_time"))
    return feeds.partition_changes(meta, "2000-01-01 00:00:00").select("ds", "any", day("dt").alias("dt"))


def altered_tables(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("ds")).agg(minute(F.max("o_orderdate")).alias("last_altered"))
    tokens = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("ds"), F.lit("2000-06-01 00:00:00").alias("token"))
    return feeds.altered(o, tokens)


def located_changes(spark: SparkSession, sf: str) -> DataFrame:
    details = table(spark, sf, "customer").select(F.col("c_name").alias("ds"), F.concat(F.lit("s3://lake/"), F.col("c_custkey").cast("string"), F.lit("/")).alias("location"))
    changes = table(spark, sf, "orders").where("o_orderdate >= '2001-01-01'").select(F.concat(F.lit("s3://lake/"), F.col("o_custkey").cast("string")).alias("location"), day("o_orderdate").alias("partition"))
    return feeds.located_changes(details, changes)


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """What a pull of a query log takes, with the token to hold back to."""
    k = F.col("o_orderkey")
    log = table(spark, sf, "orders").select(k.alias("query_id"), F.lit("INSERT").alias("query_text"), F.when(k % 3 == 0, "SELECT").when(k % 3 == 1, "INSERT").otherwise("MERGE").alias("query_type"), F.when(k % 10 == 0, "FAIL").otherwise("SUCCESS").alias("execution_status"), F.col("o_orderdate").alias("start_time"))
    pulled = feeds.statements_since(log, "2000-01-01 00:00:00")
    return pulled.agg(F.count("*").alias("n"), F.max("query_id").alias("last_id"), minute(feeds.held_back(F.col("start_time"), 3)).alias("token"))


def engine_lineage(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    native = p.where("k % 3 = 0").select((F.col("k") % 50).alias("dst"), F.col("k").alias("src"))
    parsed = p.where("k % 3 = 1").select((F.col("k") % 80).alias("dst"), F.col("k").alias("src"))
    return feeds.engine_edges(native, parsed)


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), F.concat(F.lit("e"), k.cast("string")).alias("etag"), F.when(k % 100 != 0, F.col("o_orderdate").cast("timestamp")).alias("modified"), k.alias("k"), F.col("o_orderdate").alias("at"))


def listing_since_token(spark: SparkSession, sf: str) -> DataFrame:
    """A listing up to 1999 leaves a token; later files, and those that came to its last moment afterwards, are new."""
    files = _listing(spark, sf)
    none = spark.createDataFrame([], "t timestamp, etag string")
    token = feeds.next_token(files.where("at <= '1999-06-30' and k % 2 = 0"), none)
    return feeds.changed_objects(files.where("at <= '1999-12-31'").select("path", "etag", "modified"), token).select("path")


def listing_token(spark: SparkSession, sf: str) -> DataFrame:
    token = feeds.next_token(_listing(spark, sf), spark.createDataFrame([("1995-01-01", "x")], "t string, etag string").withColumn("t", F.col("t").cast("timestamp")))
    return token.select(minute("t").alias("t"), "etag")


def _graph(spark: SparkSession, sf: str, lo: int, hi: int, mapping: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").where(f"p_partkey % 100 between {lo} and {hi}").select(k.alias("src"), (k + 1).alias("dst"), F.element_at(F.array(F.lit("sql:a"), F.lit("dbt:m"), F.lit("dbtx")), (k % 3 + 1).cast("int")).alias("evidence"), F.lit(mapping).alias("mapping"))


def merged_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A stored graph under one whose dbt edges were read anew."""
    return store.merge(_graph(spark, sf, 0, 59, "old"), _graph(spark, sf, 40, 99, "new"), ["src", "dst", "evidence"], ("dbt:",))


def appended_events(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tidemark/events-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "event_type")
    for k in range(2):
        store.append(e.where(f"event_id % 2 = {k}"), path)
    return spark.read.schema(e.schema).parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def dumped_tables(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tidemark/dump-{uuid.uuid4().hex}"
    store.dump({"customer": table(spark, sf, "customer"), "nation": table(spark, sf, "nation")}, path)
    return store.load(spark, "customer", path).join(store.load(spark, "nation", path), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", digits("c_acctbal", 2).alias("c_acctbal"), "n_name")


def full_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tidemark/full-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    store.rebuild_all(o.where("o_orderkey % 2 = 0"), path, ["o_orderpriority"])
    store.rebuild_all(o.where("o_orderpriority <> '5-LOW'"), path, ["o_orderpriority"])
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def erased_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tidemark/files-{uuid.uuid4().hex}"
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    n.repartition("n_regionkey").write.partitionBy("n_regionkey").parquet(path)
    rows = spark.read.parquet(path)
    gone = [r["f"] for r in rows.where("n_regionkey = 2").select(F.col("_metadata.file_path").alias("f")).distinct().collect()]
    store.erase_files(spark, gone)
    return spark.read.schema("n_nationkey int, n_regionkey int").parquet(path).select("n_nationkey")


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest for each brand: its parts are models by day or month, each made of the part of half its key, if that is one of the brand's, and of a source; some are tests."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    uid = lambda c: F.concat(F.lit("model.p"), text(c))
    node = F.struct(
        F.when(k % 10 == 9, "test").otherwise("model").alias("resource_type"), F.lit("db").alias("database"), F.lower("p_brand").alias("schema"), F.concat(F.lit("p"), text(k)).alias("name"), F.struct(F.array(uid(F.floor(k / 2)), F.lit("source.raw")).alias("nodes")).alias("depends_on"),
        F.struct(F.struct(F.lit("dt").alias("field"), F.when(k % 3 == 0, "DAY").when(k % 3 == 1, "month").alias("granularity")).alias("partition_by")).alias("config"),
    )
    source = F.create_map(F.lit("source.raw"), F.struct(F.lit("source").alias("resource_type"), F.lit("db").alias("database"), F.lit("raw").alias("schema"), F.col("p_brand").alias("name")))
    nodes = table(spark, sf, "part").groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct(uid(k).alias("key"), node.alias("value")))).alias("nodes"))
    return nodes.select(F.to_json(F.struct(F.struct(F.lit("duckdb").alias("adapter_type"), F.col("p_brand").alias("project_name")).alias("metadata"), source.alias("sources"), "nodes")).alias("value"))


def dbt_tables(spark: SparkSession, sf: str) -> DataFrame:
    return dbt.manifests(_manifests(spark, sf)).select("ds", "kind", "field", "grain")


def dbt_edges(spark: SparkSession, sf: str) -> DataFrame:
    return dbt.edges(dbt.manifests(_manifests(spark, sf)))


def span_times(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as spans: each is a child of the one with half its key."""
    k = F.col("o_orderkey")
    spans = table(spark, sf, "orders").select(k.alias("span"), F.when(k > 1, F.floor(k / 2).cast("long")).alias("parent"), F.round(F.col("o_totalprice") / (k + 1)).alias("seconds"))
    return observe.span_times(spans).select("span", "n_children", digits("self_seconds", 3).alias("self_seconds"))


def shared_passages(spark: SparkSession, sf: str) -> DataFrame:
    """How long a text documents and benchmark items hold in common, for the pairs that share a five-word gram."""
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents").select("doc_id", "text")
    pairs = ml.gram_containment(ml.gram_sets(items, "item_id", "text", 5), ml.gram_sets(docs, "doc_id", "text", 5)).select("item", "doc")
    both = pairs.join(items.select(F.col("item_id").alias("item"), F.col("text").alias("a")), "item").join(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("b")), "doc")
    return both.select("item", "doc", long(F.length(t.longest_common("a", "b"))).alias("n_chars")).where("n_chars is not null")


def overlap_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that two customers in a row of one nation both ordered, over the fewer of the two."""
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("parts"))
    a, b = o.select(F.col("o_custkey").alias("k"), F.col("parts").alias("a")), o.select((F.col("o_custkey") - 1).alias("k"), F.col("parts").alias("b"))
    return a.join(b, "k").select("k", digits(t.overlap(F.col("a"), F.col("b"))).alias("overlap"))


def rendered_prompts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.lower("c_mktsegment"))
    return c.select("c_custkey", t.render(F.lit("Dear {{ name }}: {segment}, {other}. {{name}}"), values).alias("prompt"))


def closest_names(spark: SparkSession, sf: str) -> DataFrame:
    """What was meant by names of segments that lost a letter, for every customer."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % F.length("c_mktsegment") + 1).cast("int").alias("at"))
    typed = F.concat(F.expr("substring(c_mktsegment, 1, at - 1)"), F.expr("substring(c_mktsegment, at + 1)"))
    known = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return c.select("c_custkey", t.did_you_mean(F.lower(typed), known).alias("meant"))


_NAMES = (
    sql_column_lineage, sql_partition_reach, statement_lineage, delta_checkpoint_log, delta_source, listed_partitions, iceberg_changes, iceberg_expired, iceberg_partitions, changed_partition_metadata, altered_tables, located_changes, query_log, engine_lineage, listing_since_token, listing_token,
    merged_graph, appended_events, dumped_tables, full_rebuild, erased_files, dbt_tables, dbt_edges, span_times, shared_passages, overlap_coefficient, rendered_prompts, closest_names,
)
QUERIES = {f.__name__: f for f in _NAMES}

_FILES = "f AS (SELECT o_orderkey AS k, o_orderdate AS day, CASE WHEN o_orderkey % 100 <> 0 THEN o_orderdate END AS modified FROM orders)"
_WORDS = r"list_filter(string_split(lower(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))), ' '), lambda w: w <> '')"
_GRAMS = "SELECT DISTINCT {id} AS key, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS gram FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT {id}, {w} AS w FROM {t}) WHERE len(w) > 0)"


def _values(rows: Iterable[tuple]) -> str:
    """Rows as SQL's VALUES has them."""
    shown = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


_RUNS = f"r AS (SELECT o_orderkey % {len(FORMS)} AS k, (o_custkey % {SHOPS})::VARCHAR AS c, count(*) AS n_runs FROM orders GROUP BY 1, 2)"
ORACLE_SQL = {
    "sql_column_lineage": f"""
WITH {_RUNS} SELECT replace(e.dst, '{{c}}', c) AS dst, replace(src, '{{c}}', c) AS src, src_col, dst_col, sum(n_runs)::BIGINT AS n_runs
FROM r JOIN (VALUES {_values((k, dst, *e) for k, (_, dst, es, _) in enumerate(FORMS) for e in es)}) e(k, dst, src, src_col, dst_col) USING (k) GROUP BY ALL""",
    "sql_partition_reach": f"""
WITH {_RUNS}, x AS (SELECT replace(e.dst, '{{c}}', c) AS dst, replace(src, '{{c}}', c) AS src, field, form, source, grain, lo, hi FROM r JOIN (VALUES {_values((k, dst, *e) for k, (_, dst, _, es) in enumerate(FORMS) for e in es)}) e(k, dst, src, field, form, source, grain, lo, hi) USING (k))
SELECT dst, src, field, CASE WHEN n = 1 THEN form ELSE 'any' END AS form, CASE WHEN n = 1 THEN source END AS source, CASE WHEN n = 1 THEN grain END AS grain, CASE WHEN n = 1 THEN lo ELSE 0 END::BIGINT AS lo, CASE WHEN n = 1 THEN hi ELSE 0 END::BIGINT AS hi
FROM (SELECT dst, src, field, count(DISTINCT (form, source, grain)) AS n, min(form) AS form, min(source) AS source, min(grain) AS grain, min(lo) AS lo, max(hi) AS hi FROM x GROUP BY dst, src, field)""",
    "statement_lineage": f"""
WITH {_RUNS}, x AS (SELECT DISTINCT k, c, n_runs, s, replace(e.dst, '{{c}}', c) AS dst, replace(src, '{{c}}', c) AS src FROM r JOIN (VALUES {_values((k, s, dst, e[0]) for k, (s, dst, es, _) in enumerate(FORMS) for e in es)}) e(k, s, dst, src) USING (k))
SELECT dst, src, count(DISTINCT replace(s, '{{c}}', c)) AS n_statements, sum(n_runs)::BIGINT AS n_runs FROM x GROUP BY dst, src""",
    "delta_checkpoint_log": "SELECT 'f' || n_nationkey AS path FROM nation WHERE n_nationkey BETWEEN 3 AND 9 AND n_nationkey <> 5 OR n_nationkey >= 20",
    "delta_source": "SELECT 'f' || n_nationkey AS path FROM nation WHERE n_nationkey BETWEEN 3 AND 9 AND n_nationkey <> 5 OR n_nationkey >= 20",
    "listed_partitions": "SELECT DISTINCT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m FROM orders WHERE year(o_orderdate) > 1996",
    "iceberg_changes": "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS dt, true AS complete FROM orders WHERE year(o_orderdate) > 1999",
    "iceberg_expired": "SELECT false AS complete, count(DISTINCT o_orderdate::DATE) AS n FROM orders",
    "iceberg_partitions": """
SELECT o_orderkey, strftime(TIMESTAMP '1970-01-01' + to_months((o_orderkey % 700)::INTEGER), '%Y-%m-%d %H:%M:%S') AS month, strftime(TIMESTAMP '1970-01-01' + to_years((o_orderkey % 60)::INTEGER), '%Y-%m-%d %H:%M:%S') AS year,
  strftime(TIMESTAMP '1970-01-01' + to_hours(o_orderkey % 500000), '%Y-%m-%d %H:%M:%S') AS hour FROM orders""",
    "changed_partition_metadata": """
SELECT o_orderkey::VARCHAR AS ds, o_orderkey % 5 = 1 AS "any", CASE WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y-%m-01') WHEN o_orderkey % 5 > 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS dt FROM orders WHERE o_orderdate > '2000-01-01'""",
    "altered_tables": """
SELECT o_custkey::VARCHAR AS ds, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS token FROM orders GROUP BY o_custkey HAVING o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) OR max(o_orderdate) > '2000-06-01'""",
    "located_changes": "SELECT DISTINCT c_name AS ds, strftime(o_orderdate, '%Y-%m-%d') AS partition FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= '2001-01-01'",
    "query_log": """
SELECT count(*) AS n, arg_max(k, (d, k)) AS last_id, strftime(max(d) - INTERVAL 3 HOURS, '%Y-%m-%d %H:%M:%S') AS token FROM (SELECT o_orderkey AS k, o_orderdate AS d FROM orders WHERE o_orderdate > '2000-01-01' AND o_orderkey % 3 > 0 AND o_orderkey % 10 <> 0 ORDER BY d, k LIMIT 100000)""".replace("arg_max(k, (d, k))", "max(k)"),
    "engine_lineage": """
WITH n AS (SELECT DISTINCT p_partkey % 50 AS dst, p_partkey AS src FROM part WHERE p_partkey % 3 = 0), l AS (SELECT DISTINCT p_partkey % 80 AS dst, p_partkey AS src FROM part WHERE p_partkey % 3 = 1)
SELECT dst, src, false AS from_log FROM n UNION ALL SELECT dst, src, true FROM l WHERE dst NOT IN (SELECT dst FROM n)""",
    "listing_since_token": f"""
WITH {_FILES}, o AS (SELECT * FROM f WHERE day <= '1999-06-30' AND k % 2 = 0), c AS (SELECT max(modified) AS t FROM o)
SELECT 'f' || k AS path FROM f, c WHERE day <= '1999-12-31' AND (modified IS NULL OR modified >= t AND k NOT IN (SELECT k FROM o WHERE modified = t))""",
    "listing_token": f"WITH {_FILES} SELECT strftime(modified, '%Y-%m-%d %H:%M:%S') AS t, 'e' || k AS etag FROM f WHERE modified = (SELECT max(modified) FROM f)",
    "merged_graph": """
WITH g AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, ['sql:a', 'dbt:m', 'dbtx'][p_partkey % 3 + 1] AS evidence, p_partkey % 100 AS r FROM part)
SELECT src, dst, evidence, CASE WHEN r >= 40 THEN 'new' ELSE 'old' END AS mapping FROM g WHERE r >= 40 OR evidence <> 'dbt:m'""",
    "appended_events": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1",
    "dumped_tables": "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "full_rebuild": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1",
    "erased_files": "SELECT n_nationkey FROM nation WHERE n_regionkey <> 2",
    "dbt_tables": """
SELECT 'duckdb/db.' || lower(p_brand) || '.p' || p_partkey AS ds, 'model' AS kind, 'dt' AS field, CASE p_partkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' END AS grain FROM part WHERE p_partkey % 10 <> 9
UNION ALL SELECT DISTINCT 'duckdb/db.raw.' || p_brand, 'source', NULL, NULL FROM part""",
    "dbt_edges": """
WITH m AS (SELECT p_partkey AS k, p_brand, 'duckdb/db.' || lower(p_brand) || '.p' || p_partkey AS ds FROM part WHERE p_partkey % 10 <> 9)
SELECT a.ds AS src, b.ds AS dst FROM m b JOIN m a ON a.k = b.k // 2 AND a.p_brand = b.p_brand UNION ALL SELECT 'duckdb/db.raw.' || p_brand, ds FROM m""",
    "span_times": """
WITH s AS (SELECT o_orderkey AS span, CASE WHEN o_orderkey > 1 THEN o_orderkey // 2 END AS parent, round(o_totalprice / (o_orderkey + 1)) AS seconds FROM orders), c AS (SELECT parent, sum(seconds) AS inside, count(*) AS n FROM s GROUP BY 1)
SELECT span, coalesce(n, 0) AS n_children, round(greatest(0, seconds - coalesce(inside, 0)), 3) AS self_seconds FROM s LEFT JOIN c ON c.parent = s.span""",
    "shared_passages": f"""
WITH i AS ({_GRAMS.format(id="item_id", w=_WORDS, t="benchmark")}), d AS ({_GRAMS.format(id="doc_id", w=_WORDS, t="documents")}), p AS (SELECT DISTINCT i.key AS item, d.key AS doc FROM i JOIN d USING (gram)),
x AS (SELECT item, doc, b.text AS a, d.text AS b, unnest(range(1, greatest(length(b.text) - 38, 1))) AS pos FROM p JOIN benchmark b ON item_id = item JOIN documents d ON doc_id = doc),
y AS (SELECT item, doc, a, b, pos FROM x WHERE contains(b, substring(a, pos, 40))),
z AS (SELECT item, doc, (SELECT max(n) FROM range(40, length(a) - pos + 2) r(n) WHERE contains(b, substring(a, pos, n))) AS n FROM y)
SELECT item, doc, max(n)::BIGINT AS n_chars FROM z GROUP BY 1, 2""",
    "overlap_coefficient": """
WITH s AS (SELECT DISTINCT o_custkey AS k, l_partkey % 50 AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1)
SELECT a.k, round(coalesce(c, 0) / least(a.n, b.n), 6)::DOUBLE AS overlap FROM n a JOIN n b ON b.k = a.k + 1 LEFT JOIN (SELECT x.k, count(*) AS c FROM s x JOIN s y ON y.k = x.k + 1 AND x.p = y.p GROUP BY 1) c ON c.k = a.k""",
    "rendered_prompts": "SELECT c_custkey, 'Dear ' || c_name || ': ' || lower(c_mktsegment) || ', {other}. ' || c_name AS prompt FROM customer",
    "closest_names": "SELECT c_custkey, c_mktsegment AS meant FROM customer",
}
