"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every text is cut into words. The fingerprints of a text are, for each run of
`WINDOW - GRAM + 1` consecutive word 5-grams, the least of their hashes: two
texts that share WINDOW consecutive words share a fingerprint, so joining the
fingerprints of documents and items finds every document that can hold a
window. Hits are then extended on those documents alone: all their windows are
joined with the items' windows, and the covered words counted.

Items shorter than a window are one window of their own length; for these the
same guarantee needs a fingerprint at every position, so each such length (at
most 12) adds one dense pass, and only when the benchmark has such items.

Null texts have no words; empty tables give no rows, or no hits. Repeated rows
each get their result. Items without an id add hits but no item. Other columns
of either table, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import NOT_ALNUM, ascii_lower, let, sliding_min, split_words, window_hashes
from tidemark.session import materialize

WINDOW = 13
GRAM = 5
#: A side of up to so many (hash, item) rows, as counted, is broadcast: 16 MB. Beyond it the join shuffles.
BROADCAST_ROWS = 1 << 20


def _word_lists(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (the id alone may repeat), words."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("text").alias("key"), split_words(ascii_lower(F.col("text")), NOT_ALNUM).alias("words"))


def _fingerprints(words: DataFrame, window: int, gram: int) -> DataFrame:
    grams = words.withColumn("grams", window_hashes(F.col("words"), gram))
    return grams.withColumn("marks", F.array_distinct(sliding_min(F.col("grams"), window - gram + 1))).drop("grams")


def small(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if its rows, counted, are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _window_hashes(words: Column, length: int, shorter: bool) -> Column:
    """The hash of every window of `length` words; of a text with fewer, but not none, all of it if `shorter`.

    Hashes are made inside the row, so that a long text's words are not copied for each of its windows.
    """
    none = F.array().cast("array<bigint>")

    def each(w: Column) -> Column:
        n = F.least(F.size(w), F.lit(length))
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) >= (1 if shorter else length), hashes).otherwise(none)

    return let(words, each)


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, n, hash) of every window of every item; n is its words, `window` or fewer."""
    words = _word_lists(items, id_col, text_col)
    hashed = words.select(F.col("id").alias("item"), F.least(F.size("words"), F.lit(window)).alias("n"), F.explode_outer(_window_hashes(F.col("words"), window, True)).alias("hash"))
    return hashed.where("hash is not null").distinct()


def _all_windows(words: DataFrame, n: int) -> DataFrame:
    """(id, key, at, n, hash) of every window of n words, hashed as `item_windows` does."""
    at = words.select("id", "key", F.posexplode_outer(_window_hashes(F.col("words"), n, False)).alias("at", "hash"))
    return at.select("id", "key", "at", F.lit(n).alias("n"), "hash").where("hash is not null")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document row: id, key (the hash of its text), n_words, n_hit, n_items, items (sorted ids as strings)."""
    windows = materialize(item_windows(items, item_id, item_text, window), "item-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `window` values
    words = _word_lists(docs, doc_id, doc_text)

    found = []
    base = words
    if window in lengths:
        long_items = _word_lists(items, item_id, item_text).where(F.size("words") >= window)
        marks = materialize(_fingerprints(long_items, window, gram).select(F.explode_outer("marks").alias("mark")).where("mark is not null").distinct(), "item-marks")
        base = _fingerprints(words, window, gram)
        found.append(base.select("id", "key", F.explode_outer("marks").alias("mark")).join(small(marks), "mark", "left_semi").select("id", "key"))
    for n in lengths:
        if n < window:
            short = windows.where(F.col("n") == n).select("hash").distinct()
            found.append(_all_windows(words, n).select("id", "key", "hash").join(small(short), "hash", "left_semi").select("id", "key"))

    counts = words.select("id", "key", F.size("words").cast("long").alias("n_words"))
    if not found:
        return counts.select("id", "key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"))
    candidates = materialize(reduce(DataFrame.unionByName, found).distinct(), "candidates")
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])
    near = words.join(small(candidates).alias("c"), (words["id"].eqNullSafe(F.col("c.id"))) & (words["key"] == F.col("c.key")), "left_semi").dropDuplicates(["id", "key"])
    at = reduce(DataFrame.unionByName, [_all_windows(near, n) for n in lengths])
    hits = materialize(at.join(small(windows.select("n", "hash").distinct()), ["n", "hash"], "left_semi"), "hits")

    covered = (
        hits.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans"))
        .select("id", "key", F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach")), lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(x["at"], s["reach"]))).alias("hit"), F.greatest(s["reach"], x["at"] + x["n"]).alias("reach")), lambda s: s["hit"]).alias("n_hit"))
    )
    pairs = hits.select("id", "key", "n", "hash").distinct().join(small(windows), ["n", "hash"]).where("item is not null").select("id", "key", F.col("item").cast("string").alias("item")).distinct()
    held = pairs.groupBy("id", "key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    results = materialize(covered.join(held, same(covered, held), "left").select(covered["id"], covered["key"], "n_hit", "items"), "contamination")
    return counts.join(results, same(counts, results), "left").select(
        counts["id"], counts["key"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated() -> Column:
    """At least one word hit, and a twentieth of all words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of 13 words of the benchmark's items."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


QUERIES = {"op9_decontamination": op9_decontamination}

_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))
),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
}
