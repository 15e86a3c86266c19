"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; `run` writes every stage's result as Parquet in the shared folder and
reads it again as the next one's docs.

Cases that every stage defines: columns beyond those of documents are dropped,
whatever their names; an empty table gives an empty one; a document may be of
any length. A null or empty text has no language and goes in the first stage;
later stages, given one, keep it (one of all such, in near-duplicates) and pack
its closing token. Null ids and repeated rows are rows like others, of which
near-duplicates keeps one. lang, source and n_chars may be null and pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, langid, packing, pii, simhash
from tidemark.session import materialize, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: those that have no text or no letter."""
    del sf_dir
    ship(spark)
    rows = _documents(docs)
    out = langid.identify(rows.select(F.struct(*COLUMNS).alias("row")), langid.model_of(rows), "row", "row.text")
    return out.where(F.col("lang_pred") != langid.UNDETERMINED).select("id.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the one with the smallest id."""
    del sf_dir
    ship(spark)
    rows = _documents(docs)
    groups = materialize(simhash.near_duplicates(rows), "groups")
    plain = groups.agg((F.count("*") == F.count_distinct("id")).alias("ok")).first()["ok"]
    if plain:
        gone = groups.where(F.col("id") != F.col("component")).select(F.col("id").alias("doc_id"))
        return rows.join(decontamination.small(gone), "doc_id", "left_anti").select(*COLUMNS)
    # Ids repeat or are missing: rows travel with their own fingerprints, and one of each group stays.
    marked = simhash.fingerprints(rows.select(F.struct(*COLUMNS).alias("row"), "text"), "row")
    classes = groups.select("fp", "group", "component").distinct()
    kept = marked.join(classes, "fp").where(F.col("id.doc_id").eqNullSafe(F.col("component")))
    return kept.dropDuplicates(["group"]).select("id.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    rows = _documents(docs)
    found = decontamination.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = decontamination.small(materialize(found.where(decontamination.is_contaminated()).select("id", "key").distinct(), "contaminated"))
    marked = rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad["id"]) & (marked["key"] == bad["key"]), "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows."""
    del spark, sf_dir
    rows = pii.detect(_documents(docs), keep=COLUMNS)
    text = F.when(F.size("spans") > 0, pii.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", "n_chars", (F.size("spans") > 0).alias("_changed")).withColumn("n_chars", F.when(F.col("_changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("_changed")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack every document into windows of 2048 tokens."""
    del sf_dir
    ship(spark)
    return packing.pieces(_documents(docs), packing.default_tokenizer())


STAGES = [
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the result of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Language models, fingerprints and token packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
