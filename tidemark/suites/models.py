"""Corpora, embeddings, evaluations, training runs and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import chunk_digest, containment, digest, ngrams, normalize, template_variables, token_estimate, words
from tidemark.operators import ml as m
from tidemark.suites import day, digits, long, table


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut at their lines."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).select("doc_id", long("ordinal").alias("ordinal"), "text", chunk_digest(F.col("text")).alias("digest"))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """An older index: it lacks every tenth document, holds other text for every seventh, and a document that is gone."""
    old = F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("digest"))
    return _chunks(spark, sf).where("doc_id % 10 <> 3").select((F.when(F.col("doc_id") % 25 == 1, -F.col("doc_id")).otherwise(F.col("doc_id"))).alias("doc_id"), "ordinal", old.alias("digest"))


def stale_chunks(spark: SparkSession, sf: str) -> DataFrame:
    s = m.stale_chunks(_chunks(spark, sf), _index(spark, sf), ["doc_id", "ordinal"], "digest")
    return s.select("doc_id", "ordinal", "reason", token_estimate(F.col("text")).alias("tokens"))


def orphan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return m.orphan_vectors(_index(spark, sf), _chunks(spark, sf), ["doc_id", "ordinal"]).select("doc_id", "ordinal")


def reindex_savings(spark: SparkSession, sf: str) -> DataFrame:
    s = m.stale_chunks(_chunks(spark, sf), _index(spark, sf), ["doc_id", "ordinal"], "digest").agg(F.count("*").alias("stale"), F.sum(token_estimate(F.col("text"))).alias("tokens"))
    t = _chunks(spark, sf).agg(F.count("*").alias("total"))
    return s.crossJoin(t).select("stale", "tokens", "total", digits(1 - F.col("stale") / F.col("total")).alias("savings"))  # one row each


def centroid_shift(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    a, b = (m.centroids(e.where(f"vec_id % 2 = {i}"), "label", "embedding") for i in (0, 1))
    return m.centroid_shift(a, b, "label").select(long("label").alias("label"), digits("shift", 4).alias("shift"), digits("norm_change", 4).alias("norm_change"))


def identifier_overlap(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    x = m.identifier_overlap(o.where("o_orderdate < '1998-01-01'"), o.where("o_orderdate >= '1998-01-01' and o_custkey % 3 = 0"), "o_custkey")
    return x.select("n_shared", digits("ratio").alias("ratio"))


def ngram_containment(spark: SparkSession, sf: str) -> DataFrame:
    items = m.gram_sets(table(spark, sf, "benchmark"), "item_id", "text", 5)
    docs = m.gram_sets(table(spark, sf, "documents"), "doc_id", "text", 5)
    return m.gram_containment(items, docs).select("item", "doc", "n_shared", digits("containment").alias("containment"))


def exact_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar pairs of different texts, each text by its least document; its copies follow as pairs with it."""
    sets, members = m.set_classes(m.gram_sets(table(spark, sf, "documents"), "doc_id", "text", 5))
    pairs = m.jaccard_pairs(sets, 0.8).select("a", "b", digits("jaccard").alias("jaccard"))
    return pairs.unionByName(members.select(F.col("first").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("jaccard")))


def minhash_clusters(spark: SparkSession, sf: str) -> DataFrame:
    sets, members = m.set_classes(m.gram_sets(table(spark, sf, "documents"), "doc_id", "text", 5))
    return m.clusters(m.lsh_links(sets, 32, 4, 0.8), members)


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    t = normalize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("digest"), long(F.size(words(t))).alias("n_words"))


def text_grams(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each conversation's second turn repeats its first, by 3-grams."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", words(normalize(F.col("text"))).alias("w"))
    a = c.where("turn = 0").select("conv_id", F.array_distinct(ngrams(F.col("w"), 3)).alias("a"))
    b = c.where("turn = 1").select("conv_id", F.array_distinct(ngrams(F.col("w"), 3)).alias("b"))
    return a.join(b, "conv_id").select("conv_id", digits(containment(F.col("b"), F.col("a"))).alias("repeated"))


def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


def fertility_by_language(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("lang", token_estimate(F.col("text")).alias("tokens"), long(F.size(words(normalize(F.col("text"))))).alias("words"))
    return d.groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).select("lang", "tokens", "words", digits(F.col("tokens") / F.col("words")).alias("fertility"))


def epoch_pressure(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("available"))
    mix = spark.range(0, 25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), (F.col("id") % 5 * 0.01).alias("weight"))
    e = m.epoch_pressure(mix, have, 4_000_000.0)
    return e.select("source", digits("required").alias("required"), F.col("available").cast("double").alias("available"), digits("epochs").alias("epochs"), "repeats")


def vocabulary_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Words of ten documents' text that only English, or only French, has."""
    d = table(spark, sf, "documents").select("lang", F.explode(F.array_distinct(words(normalize(F.col("text"))))).alias("word"))
    g = d.groupBy("word").agg(F.max((F.col("lang") == "en").cast("int")).alias("en"), F.max((F.col("lang") == "fr").cast("int")).alias("fr")).where("en + fr = 1")
    return g.groupBy(F.when(F.col("en") == 1, "removed").otherwise("added").alias("change")).agg(F.count("*").alias("n"))


def annotator_gini(spark: SparkSession, sf: str) -> DataFrame:
    shares = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return m.gini(shares, "n").select(digits("gini").alias("gini"), digits("top_share").alias("top_share"))


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select((F.col("l_partkey")).alias("item"), (F.col("l_suppkey") % 2).alias("who"), "l_returnflag")
    votes = e.groupBy("item", "who").agg(F.min("l_returnflag").alias("vote"))
    return m.agreement(votes, "item", "who", "vote", 0, 1).select("n", digits("agreement").alias("agreement"))


def rank_stability(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n"))
    return g.agg(F.count("*").alias("prompts"), F.count_if(F.col("n") > 1).alias("unstable"))


def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select("p_partkey", long(F.round(F.col("p_retailprice") * 100)).alias("cost"), (F.col("p_partkey") * 7919 % 1009).alias("score"))
    return m.pareto(t, "p_partkey", "cost", "score").select("p_partkey", "cost", "score")


def scaling_law_fit(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("x"), (3.0 * F.pow(F.col("o_orderkey").cast("double"), -0.3) * (1 + (F.col("o_orderkey") % 7) / 100) + 1.5).alias("y"))
    f = m.scaling_fit(p.where("x > 0"), "x", "y", 1.5)
    return f.select(digits("exponent").alias("exponent"), digits("coefficient", 4).alias("coefficient"), digits("rmse").alias("rmse"), "n")


def refusal_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels as expected, toxic ones as observed refusals, by source."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    g = j.groupBy("source").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("over"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("under"))
    return g.select("source", "n", digits(F.col("over") / F.col("n")).alias("over_rate"), digits(F.col("under") / F.col("n")).alias("under_rate"))


def safety_regressions(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels")
    before = l.select("doc_id", (F.col("quality") == 1).alias("passed"))
    after = l.where("doc_id % 9 <> 0").select("doc_id", ((F.col("quality") == 1) & (F.col("doc_id") % 5 != 0)).alias("now"))
    j = before.join(after, "doc_id", "left")
    kind = F.when(F.col("now").isNull(), "missing").when(F.col("passed") & ~F.col("now"), "broke")
    return j.select("doc_id", kind.alias("change")).where("change is not null")


def asof_version(spark: SparkSession, sf: str) -> DataFrame:
    """Each order with the event that its user had last made: events move to 1996."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate")
    e = table(spark, sf, "events").groupBy("user_id", (F.col("ts") - F.make_ym_interval(F.lit(28))).alias("since")).agg(F.max("event_type").alias("version"))
    return m.as_of(o, e, "user_id", "o_orderdate", "since", "version").select("o_orderkey", "version")


def metric_changes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("c", long(F.round(F.col("o_totalprice"))))
    a, b = (o.where(f"year(o_orderdate) = {y}").groupBy("o_orderpriority").agg(F.max("c").alias("v")) for y in (1996, 1997))
    return m.metric_changes(a, b, "o_orderpriority", "v")


def expired_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return m.keep_last(table(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_orderkey")


def loss_spikes(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").withColumn("before", F.lag("o_totalprice").over(w))
    return o.where(F.col("o_totalprice") > 1.5 * F.col("before")).select("o_orderkey")


def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "l_partkey").limit(10)


def citation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("retrieved"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("cited"))
    return l.select("l_orderkey", digits(F.col("cited") / F.col("retrieved")).alias("coverage"))


def prompt_variables(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Dear {{name}}, "), F.when(F.col("c_custkey") % 2 == 0, F.lit("your {segment} and { name }")).otherwise(F.lit("plain")), F.lit(" {"), F.col("c_mktsegment"), F.lit("}")).alias("t"))
    return c.select("c_custkey", F.array_join(template_variables(F.col("t")), ",").alias("variables"))


def prompt_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that differ in white space alone are one version."""
    return table(spark, sf, "conversations").select(digest(F.regexp_replace("text", " ", "  "), 16).alias("version")).groupBy("version").agg(F.count("*").alias("n"))


def stale_features(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose last order is over a year old at the table's end; those without orders count as stale."""
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    c = table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.where(F.coalesce(F.to_date("at") < F.lit("2000-08-01").cast("date"), F.lit(True))).select("c_custkey", day("at").alias("last"))


def weighted_regression(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.year("o_orderdate") == 1997).alias("a"), F.count_if(F.year("o_orderdate") == 1996).alias("b"))
    delta = (F.col("a") - F.col("b")) / F.greatest(F.col("b"), F.lit(1))
    return g.agg(digits(F.sum(delta * F.greatest("n", F.lit(1))) / F.sum(F.greatest("n", F.lit(1)))).alias("delta"))


_NAMES = (stale_chunks, orphan_vectors, reindex_savings, centroid_shift, identifier_overlap, ngram_containment, exact_jaccard_pairs, minhash_clusters, text_normalize, text_grams, token_budget, fertility_by_language, epoch_pressure, vocabulary_diff, annotator_gini, agreement, rank_stability, pareto_front, scaling_law_fit, refusal_rates, safety_regressions, asof_version, metric_changes, expired_checkpoints, loss_spikes, top_sources, citation_coverage, prompt_variables, prompt_versions, stale_features, weighted_regression)
QUERIES = {f.__name__: f for f in _NAMES}

_CHUNKS = "c AS (SELECT doc_id, (i - 1)::BIGINT AS ordinal, t[i] AS text, left(sha256(t[i]), 32) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
_INDEX = "x AS (SELECT CASE WHEN doc_id % 25 = 1 THEN -doc_id ELSE doc_id END AS doc_id, ordinal, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE digest END AS digest FROM c WHERE doc_id % 10 <> 3)"
_STALE = f"WITH {_CHUNKS}, {_INDEX}, s AS (SELECT c.doc_id, c.ordinal, CASE WHEN x.digest IS NULL THEN 'new' ELSE 'changed' END AS reason, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT AS tokens FROM c LEFT JOIN x USING (doc_id, ordinal) WHERE x.digest IS DISTINCT FROM c.digest)"
_NORM = r"lower(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')))"
_W = f"list_filter(string_split({_NORM}, ' '), lambda w: w <> '')"
_GRAMS = "SELECT DISTINCT {id} AS key, CASE WHEN len(w) < {n} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {n} - 1], ' ') END AS gram FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS i FROM (SELECT {id}, {w} AS w FROM {t}) WHERE len(w) > 0)"
_TOKENS = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END"
_PAIRS = f"""d AS ({_GRAMS.format(id="doc_id", n=5, w=_W, t="documents")}), m AS (SELECT key, string_agg(md5(gram), '' ORDER BY gram) AS mark, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT key, n, min(key) OVER (PARTITION BY mark) AS first FROM m), s AS (SELECT key, n FROM c WHERE key = first), f AS (SELECT d.* FROM d JOIN s USING (key)),
k AS (SELECT x.key AS a, y.key AS b, count(*) AS k FROM f x JOIN f y ON x.gram = y.gram AND x.key < y.key GROUP BY 1, 2),
p AS (SELECT a, b, k / (sa.n + sb.n - k) AS jaccard FROM k JOIN s sa ON sa.key = a JOIN s sb ON sb.key = b WHERE k / (sa.n + sb.n - k) >= 0.8 UNION ALL SELECT first, key, 1.0 FROM c WHERE key <> first)"""
ORACLE_SQL = {
    "stale_chunks": _STALE + " SELECT * FROM s",
    "orphan_vectors": f"WITH {_CHUNKS}, {_INDEX} SELECT doc_id, ordinal FROM x ANTI JOIN c USING (doc_id, ordinal)",
    "reindex_savings": _STALE + " SELECT count(*) AS stale, sum(tokens)::BIGINT AS tokens, (SELECT count(*) FROM c) AS total, round(1 - count(*) / (SELECT count(*) FROM c), 6) AS savings FROM s",
    "centroid_shift": """
WITH v AS (SELECT label, vec_id % 2 AS half, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, d, avg(x) FILTER (half = 0) AS b, avg(x) FILTER (half = 1) AS a FROM v GROUP BY 1, 2),
g AS (SELECT label, sqrt(sum((a - b) * (a - b))) AS shift, sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT label::BIGINT AS label, round(shift, 4) AS shift, round((na - nb) / nb, 4) AS norm_change FROM g""",
    "identifier_overlap": """
WITH h AS (SELECT o_custkey, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < '1998-01-01') AS t FROM orders WHERE o_orderdate >= '1998-01-01' AND o_custkey % 3 = 0)
SELECT count(DISTINCT CASE WHEN t THEN o_custkey END) AS n_shared, round(count(*) FILTER (t) / count(*), 6) AS ratio FROM h""",
    "ngram_containment": f"""
WITH i AS ({_GRAMS.format(id="item_id", n=5, w=_W, t="benchmark")}), d AS ({_GRAMS.format(id="doc_id", n=5, w=_W, t="documents")}), s AS (SELECT key, count(*) AS n FROM i GROUP BY 1)
SELECT i.key AS item, d.key AS doc, count(*) AS n_shared, round(count(*) / any_value(n), 6) AS containment FROM i JOIN d USING (gram) JOIN s ON s.key = i.key GROUP BY 1, 2""",
    "exact_jaccard_pairs": f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM p",
    "minhash_clusters": f"""
WITH RECURSIVE {_PAIRS}, l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS node, a AS other FROM l UNION SELECT node, l.b FROM r JOIN l ON other = l.a)
SELECT node, min(other) AS component FROM r GROUP BY node""",
    "text_normalize": f"SELECT doc_id, md5({_NORM}) AS digest, len({_W})::BIGINT AS n_words FROM documents",
    "text_grams": f"""
WITH g AS ({_GRAMS.format(id="conv_id, turn", n=3, w=_W, t="conversations").replace("conv_id, turn AS key", "conv_id, turn AS key")})
SELECT y.conv_id, round(CASE WHEN count(y.gram) = 0 THEN 0 ELSE count(x.gram) / count(y.gram) END, 6)::DOUBLE AS repeated
FROM (SELECT c.conv_id, g.gram FROM conversations c LEFT JOIN g ON g.conv_id = c.conv_id AND g.key = 1 WHERE c.turn = 1) y
JOIN (SELECT conv_id FROM conversations WHERE turn = 0) z USING (conv_id) LEFT JOIN g x ON x.conv_id = y.conv_id AND x.key = 0 AND x.gram = y.gram GROUP BY 1""",
    "token_budget": f"SELECT source, sum({_TOKENS})::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY 1",
    "fertility_by_language": f"SELECT lang, sum({_TOKENS})::BIGINT AS tokens, sum(len({_W}))::BIGINT AS words, round(sum({_TOKENS}) / sum(len({_W})), 6) AS fertility FROM documents GROUP BY 1",
    "epoch_pressure": """
WITH m AS (SELECT 'src' || i AS source, (i % 5) * 0.01::DOUBLE * 4000000 AS r FROM range(0, 25) t(i)), a AS (SELECT source, sum(n_chars)::DOUBLE AS available FROM documents GROUP BY 1)
SELECT source, round(r, 6) AS required, available, round(r / available, 6) AS epochs, coalesce(r / available > 1, false) AS repeats FROM m LEFT JOIN a USING (source)""",
    "vocabulary_diff": f"""
WITH d AS (SELECT lang, unnest({_W}) AS word FROM documents), g AS (SELECT word, bool_or(lang = 'en') AS en, bool_or(lang = 'fr') AS fr FROM d GROUP BY 1)
SELECT CASE WHEN en THEN 'removed' ELSE 'added' END AS change, count(*) AS n FROM g WHERE en <> fr GROUP BY 1""",
    "annotator_gini": """
WITH s AS (SELECT count(*) AS x FROM events GROUP BY user_id), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM s)
SELECT round(2 * sum(i * x)::DOUBLE / (any_value(n) * sum(x)::DOUBLE) - (any_value(n) + 1)::DOUBLE / any_value(n), 6) AS gini, round(max(x) / sum(x)::DOUBLE, 6) AS top_share FROM r""",
    "agreement": """
WITH v AS (SELECT l_partkey AS item, l_suppkey % 2 AS who, min(l_returnflag) AS vote FROM lineitem GROUP BY 1, 2)
SELECT count(*) AS n, round(avg((a.vote = b.vote)::INTEGER), 6) AS agreement FROM v a JOIN v b ON a.item = b.item AND a.who = 0 AND b.who = 1""",
    "rank_stability": "SELECT count(*) AS prompts, count(*) FILTER (n > 1) AS unstable FROM (SELECT count(DISTINCT event_type) AS n FROM events GROUP BY user_id)",
    "pareto_front": """
WITH t AS (SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS cost, p_partkey * 7919 % 1009 AS score FROM part)
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.cost <= t.cost AND o.score >= t.score AND (o.cost < t.cost OR o.score > t.score))""",
    "scaling_law_fit": """
WITH p AS (SELECT ln(o_orderkey::DOUBLE) AS x, ln(3.0::DOUBLE * pow(o_orderkey::DOUBLE, -0.3::DOUBLE) * (1 + (o_orderkey % 7) / 100) + 1.5::DOUBLE - 1.5::DOUBLE) AS y FROM orders WHERE o_orderkey > 0)
SELECT round(-regr_slope(y, x), 6) AS exponent, round(exp(regr_intercept(y, x)), 4) AS coefficient, round(sqrt(greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0) / count(*)), 6) AS rmse, count(*) AS n FROM p""",
    "refusal_rates": """
SELECT source, count(*) AS n, round(count(*) FILTER (quality = 1 AND toxic = 1) / count(*), 6) AS over_rate, round(count(*) FILTER (quality = 0 AND toxic = 0) / count(*), 6) AS under_rate
FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    "safety_regressions": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE 'broke' END AS change FROM labels WHERE doc_id % 9 = 0 OR (quality = 1 AND doc_id % 5 = 0)",
    "asof_version": """
WITH e AS (SELECT user_id, ts - to_years(28) AS since, max(event_type) AS version FROM events GROUP BY 1, 2)
SELECT o_orderkey, version FROM orders o ASOF LEFT JOIN e ON e.user_id = o.o_custkey AND o.o_orderdate >= e.since""",
    "metric_changes": """
WITH v AS (SELECT o_orderpriority, year(o_orderdate) AS y, max(round(o_totalprice)::BIGINT) AS v FROM orders GROUP BY 1, 2)
SELECT a.o_orderpriority, a.v AS before, b.v AS after, b.v - a.v AS delta FROM v a JOIN v b ON a.o_orderpriority = b.o_orderpriority AND a.y = 1996 AND b.y = 1997""",
    "expired_checkpoints": "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 3",
    "loss_spikes": "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE o_totalprice > 1.5::DOUBLE * b",
    "top_sources": "SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "citation_coverage": "SELECT l_orderkey, round(count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) / count(DISTINCT l_partkey), 6) AS coverage FROM lineitem GROUP BY 1",
    "prompt_variables": "SELECT c_custkey, array_to_string(list_sort(list_distinct(CASE WHEN c_custkey % 2 = 0 THEN ['name', 'segment', c_mktsegment] ELSE ['name', c_mktsegment] END)), ',') AS variables FROM customer",
    "prompt_versions": r"SELECT left(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 16) AS version, count(*) AS n FROM conversations GROUP BY 1",
    "stale_features": """
SELECT c_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING coalesce(max(o_orderdate)::DATE < DATE '2000-08-01', true)""",
    "weighted_regression": """
WITH g AS (SELECT count(*) AS n, count(*) FILTER (year(o_orderdate) = 1997) AS a, count(*) FILTER (year(o_orderdate) = 1996) AS b FROM orders GROUP BY o_orderpriority)
SELECT round(sum((a - b) / greatest(b, 1) * greatest(n, 1)) / sum(greatest(n, 1))::DOUBLE, 6) AS delta FROM g""",
}
