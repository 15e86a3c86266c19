"""Quality by distribution divergence, in DataFrame operations only.

Two histograms of a document, of character classes and of common words (with one
bin for all other words), are compared with language references by Jensen-Shannon
distance (base 2, 0 to 1); the nearest counts, so a wrong label costs nothing.
References are the pooled histograms of all documents of a language that pass the
base rules. A document labelled with a language that has no reference is left to
the base rules, one without a label is compared with all. Texts below the minimum
lengths (characters for classes, words for words) carry too little evidence and
are left to the base rules too; long ones are held to a narrower distance.

Base rules count words, symbols, repeated lines and words in repeated windows.
Everything is computed inside the row: the only shuffle is of the references'
sums, one row for each language and bin.

Null and empty texts have no words and fail the base rules. Repeated rows each
get their result. An empty table gives no rows. Other columns, whatever their
names, are not read; `lang` may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import SPACE, ascii_lower, split_words, window_hashes
from tidemark.session import materialize

# The commonest words of each reference language.
COMMON_WORDS = {
    "de": "auf das dem den der des die ein eine im in ist mit nicht sich und von zu",
    "en": "a and are as at be by for from in is it of on that the this to was with",
    "es": "a con de del el en es la las los no para por que se su un una y",
    "fr": "au avec dans de des du elle en est et la le les par pas pour que qui sur un une",
}
#: Classes by the characters they hold; what is in none of them (above ASCII) is the last class.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x00-\x20\x7F", "punctuation": r".,;:!?'\"()\-", "symbol": r"#*$%&|<>+/=@\[\]\\^_`{}~"}
SYMBOLS = "[#*$%&|<>]+"
MIN_WORDS = 50
MIN_CHARS = 200
#: Words from which the sampled shares of a document lie close to those of its language.
LONG_WORDS = 400
#: Distances above these fail; fitted so that documents of ordinary prose lie well below.
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.36
MAX_LONG_WORD_DISTANCE = 0.25
#: The bin of all words that are not common.
OTHER = ""


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _repeated(sorted_windows: Column, k: int) -> Column:
    """Words covered by windows whose hash occurs twice or more; windows as sorted (hash, at)."""
    near = lambda j: F.get(sorted_windows, j)["hash"]
    marked = F.transform(sorted_windows, lambda x, j: F.when((x["hash"] == near(j + 1)) | ((j > 0) & (x["hash"] == near(F.greatest(j - 1, F.lit(0))))), x["at"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda s, at: F.struct((s["n"] + at + k - F.greatest(at, s["reach"])).alias("n"), (at + k).alias("reach"))
    return F.aggregate(F.sort_array(F.filter(marked, lambda at: at.isNotNull())), start, step, lambda s: s["n"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and histograms of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    t = F.col("text")
    vocabulary = sorted({w for ws in COMMON_WORDS.values() for w in ws.split()})
    rows = rows.select("id", "lang", "text", split_words(t, SPACE).alias("words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select(
        "id", "lang", "words", F.length("text").alias("n_chars"), F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"), _removed(t, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.array(*[_removed(t, f"[{c}]+").cast("double") for c in CLASSES.values()], F.length(F.regexp_replace(t, r"[\x00-\x7F]+", "")).cast("double")).alias("classes"),
        split_words(ascii_lower(t), r"[\x00-\x20.,;:!?\x7F]+").alias("plain"),
        window_hashes(F.col("words"), 3).alias("windows"),
    )
    rows = rows.withColumn("common", F.sort_array(F.filter("plain", lambda w: w.isin(vocabulary)))).withColumn("n_plain", F.size("plain"))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("windows", F.when(twice, F.sort_array(F.transform("windows", lambda h, at: F.struct(h.alias("hash"), at.alias("at"))))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("windows").isNull(), F.lit(0)).otherwise(_repeated(F.col("windows"), 3)))
    rows = rows.withColumn("bins", F.array_distinct("common"))
    counted = F.transform("bins", lambda w: F.struct(w.alias("word"), F.array_position("common", w).alias("at")))
    rows = rows.withColumn("places", counted)
    n_at = lambda x, j: F.coalesce(F.get("places", j + 1)["at"], F.size("common") + 1) - x["at"]
    counts = F.transform("places", lambda x, j: F.struct(x["word"].alias("word"), n_at(x, j).cast("double").alias("n")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words").cast("long") > 50 * F.col("n_words").cast("long"))
    return rows.select(
        "id", "lang", "n_chars", "n_plain", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), "classes", counts.alias("common"), F.size("common").cast("double").alias("n_common"),
    )


def references(rows: DataFrame) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Pooled class shares and common-word shares by reference language: a bounded table, whatever the input."""
    sound = rows.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS)))
    n = len(CLASSES) + 1
    sums = sound.groupBy("lang").agg(F.sum(F.col("n_plain") - F.col("n_common")).alias("other"), *[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(n)]).collect()
    pooled = {r["lang"]: [r[f"c{i}"] for i in range(n)] for r in sums}
    words = {r["lang"]: {OTHER: r["other"]} for r in sums}
    for r in sound.select("lang", F.explode("common").alias("x")).groupBy("lang", F.col("x.word").alias("word")).agg(F.sum("x.n").alias("n")).collect():
        words[r["lang"]][r["word"]] = r["n"]
    share = lambda xs: [x / max(sum(xs), 1.0) for x in xs]
    out = {}
    for lang, xs in sorted(pooled.items()):
        ws = dict(sorted(words[lang].items()))
        out[lang] = (share(xs), dict(zip(ws, share(list(ws.values())), strict=True)))
    return out


def _divergence(p: Column, q: Column) -> Column:
    """The part of the Jensen-Shannon divergence of one bin, in bits."""
    m = (p + q) / 2
    side = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return (side(p) + side(q)) / 2


def class_distance(classes: Column, n_chars: Column, reference: list[float]) -> Column:
    parts = F.zip_with(classes, F.array(*[F.lit(float(x)) for x in reference]), lambda n, q: _divergence(n / n_chars, q))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def word_distance(common: Column, n_common: Column, n_plain: Column, reference: dict[str, float]) -> Column:
    """Bins that the document lacks contribute half of their share, so only its own are visited."""
    shares = F.create_map(*[F.lit(x) for pair in reference.items() for x in pair])
    bins = F.array_append(common, F.struct(F.lit(OTHER).alias("word"), (n_plain - n_common).alias("n")))
    q = lambda x: F.coalesce(F.try_element_at(shares, x["word"]), F.lit(0.0))
    total = F.aggregate(bins, F.lit(0.5), lambda a, x: a + _divergence(x["n"] / n_plain, q(x)) - q(x) / 2)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def verdicts(rows: DataFrame) -> DataFrame:
    """`rows` of `features` with class_distance, word_distance (null where not judged) and kept.

    The features are written first: they are read for the references and again
    for the verdicts, and no filter may then be pushed into their making.
    """
    rows = materialize(rows, "divergence")
    refs = references(rows)
    n_chars, n_plain = F.col("n_chars").cast("double"), F.col("n_plain").cast("double")
    known = F.col("lang").isNull() | F.col("lang").isin(list(refs))

    def nearest(distances: list[Column]) -> Column:
        return F.when(known, F.array_min(F.array(*distances))) if distances else F.lit(None).cast("double")

    by_class = nearest([class_distance(F.col("classes"), n_chars, ref) for ref, _ in refs.values()])
    by_word = nearest([word_distance(F.col("common"), F.col("n_common"), n_plain, ref) for _, ref in refs.values()])
    judged = rows.withColumn("class_distance", F.when(F.col("n_chars") >= MIN_CHARS, by_class)).withColumn("word_distance", F.when(F.col("n_plain") >= MIN_WORDS, by_word))
    most = F.when(F.col("n_plain") >= LONG_WORDS, F.lit(MAX_LONG_WORD_DISTANCE)).otherwise(F.lit(MAX_WORD_DISTANCE))
    bad = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > most, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~bad)


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of every document."""
    out = verdicts(features(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


QUERIES = {"op1_divergence": op1_divergence}

_SQL_CLASSES = [*(f"length(t) - length(regexp_replace(t, '[{c.replace(chr(39), chr(39) * 2).replace(chr(92) + chr(34), chr(34))}]+', '', 'g'))" for c in CLASSES.values()), r"length(regexp_replace(t, '[\x00-\x7F]+', '', 'g'))"]
_SQL_VOCABULARY = ", ".join(f"'{w}'" for w in sorted({w for ws in COMMON_WORDS.values() for w in ws.split()}))
_SQL_LANGUAGES = ", ".join(f"'{x}'" for x in COMMON_WORDS)
_SQL_SIDE = "(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2"

ORACLE_SQL = {
    "op1_divergence": rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE k > 1) GROUP BY 1),
b AS (
  SELECT doc_id, lang, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(w) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM w LEFT JOIN r USING (doc_id)),
c AS (SELECT doc_id, lang, base_failed, length(t) AS n_chars, unnest(range(0, {len(_SQL_CLASSES)})) AS bin, unnest([{", ".join(_SQL_CLASSES)}]) AS n FROM b),
cr AS (SELECT lang AS ref, bin, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS q FROM c WHERE NOT base_failed AND lang IN ({_SQL_LANGUAGES}) GROUP BY lang, bin),
cd AS (SELECT doc_id, lang, ref, sqrt(greatest(sum({_SQL_SIDE}), 0)) AS x FROM (SELECT doc_id, lang, ref, n / n_chars AS p, q FROM c JOIN cr USING (bin) WHERE n_chars >= {MIN_CHARS}) GROUP BY 1, 2, 3),
pw AS (SELECT doc_id, word, word IN ({_SQL_VOCABULARY}) AS common FROM (SELECT doc_id, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x20.,;:!?\x7F]+')) AS word FROM b)),
v AS (SELECT doc_id, CASE WHEN common THEN word ELSE '' END AS word, count(*) AS n FROM pw GROUP BY 1, 2),
vr AS (SELECT lang AS ref, word, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM v JOIN b USING (doc_id) WHERE NOT base_failed AND lang IN ({_SQL_LANGUAGES}) GROUP BY lang, word),
vn AS (SELECT doc_id, sum(n) AS n_plain FROM v GROUP BY 1),
vp AS (SELECT doc_id, n_plain, b.lang, ref, n / n_plain AS p, coalesce(q, 0) AS q FROM v JOIN vn USING (doc_id) JOIN b USING (doc_id) CROSS JOIN (SELECT DISTINCT ref FROM vr) LEFT JOIN vr USING (ref, word) WHERE n_plain >= {MIN_WORDS}),
vd AS (SELECT doc_id, n_plain, lang, ref, sqrt(greatest(0.5 + sum({_SQL_SIDE} - q / 2), 0)) AS x FROM vp GROUP BY 1, 2, 3, 4),
cn AS (SELECT doc_id, min(x) AS x FROM cd WHERE lang IS NULL OR lang IN (SELECT ref FROM cr) GROUP BY 1),
wn AS (SELECT doc_id, n_plain, min(x) AS x FROM vd WHERE lang IS NULL OR lang IN (SELECT ref FROM vr) GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(cn.x > {MAX_CLASS_DISTANCE}, false) OR coalesce(wn.x > CASE WHEN n_plain >= {LONG_WORDS} THEN {MAX_LONG_WORD_DISTANCE} ELSE {MAX_WORD_DISTANCE} END, false)) AS kept, round(cn.x, 6) AS class_distance, round(wn.x, 6) AS word_distance
FROM b LEFT JOIN cn USING (doc_id) LEFT JOIN wn USING (doc_id)
"""
}
