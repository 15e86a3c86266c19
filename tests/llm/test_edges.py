"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination, divergence, html_extract, langid, packing, pii, ppm, registry, simhash, toxicity, warc

EN = "the quick brown fox jumps over the lazy dog and then it runs to the river with all of the other animals in that forest"
FR = "le renard brun saute par dessus le chien paresseux et puis il court vers la rivière avec tous les autres animaux de la forêt"
LONG = " ".join(f"{EN} {i}" for i in range(3000))
CLASH = ("id", "row", "key", "fp", "words", "score", "spans", "found", "text2", "component", "n", "item", "sequence_id")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, EN, "en"), (2, FR, "fr"), (3, None, "en"), (4, "", None), (5, LONG, "en"), (6, EN, "en"), (7, EN, "en"), (7, EN, "en"), (None, EN, None), (8, "12345 !!! 678", "de"), (9, " \n\t ", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    full, empty = base / "full", base / "empty"
    items = spark.createDataFrame([(1, " ".join(EN.split()[:15])), (2, "brown fox"), (3, None), (4, ""), (None, "lazy dog and")], "item_id long, text string").withColumn("id", F.lit(0)).withColumn("key", F.lit(0))
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 0), (6, 0), (6, 1), (7, None), (None, 1)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).withColumn("text", F.lit("x"))
    html = "<html><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two</p></article><footer>f</footer></body></html>"
    pages = spark.createDataFrame([(1, "http://h/a", html), (2, "http://h/b", html), (3, None, None), (4, "not a url", ""), (5, "http://h/a", html), (5, "http://h/a", html), (None, "http://h/c", html), (6, "http://h/d", f"<p>{LONG}")], "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("digest", F.lit("x")).withColumn("host", F.lit("x"))
    for path, cut in ((full, False), (empty, True)):
        for name, df in (("documents", docs), ("benchmark", items), ("labels", labels), ("pages", pages)):
            (df.where("false") if cut else df).coalesce(2).write.parquet(f"file://{path}/{name}.parquet")
    return f"file://{full}", f"file://{empty}"


@pytest.mark.parametrize("name", sorted({*registry.queries()} - {"op13_prefix_trie"}))  # its rows are nodes; see test_prefix_trie
def test_each_row_once(spark, folder, name):
    out = registry.queries()[name](spark, folder[0]).toPandas()
    key = "page_id" if "page_id" in out else "doc_id"
    rows = out[out.start == 0] if "start" in out else out
    assert len(rows) == (8 if key == "page_id" else 11)
    assert registry.queries()[name](spark, folder[1]).count() == 0


def test_words_rules(spark, folder):
    got = {r["doc_id"]: r for r in registry.queries()["op1_divergence"](spark, folder[0]).collect()}
    assert got[1]["n_words"] == len(EN.split()) and got[1]["base_failed"]
    assert got[3]["n_words"] == got[4]["n_words"] == got[9]["n_words"] == 0
    assert got[5]["n_words"] == len(LONG.split()) and got[5]["base_failed"]


def test_components(spark, folder):
    got = [(r["doc_id"], r["component_id"], r["fingerprint"]) for r in registry.queries()["op7_simhash"](spark, folder[0]).collect()]
    assert {c for d, c, _ in got if d in (1, 6, 7, None)} == {1}
    assert {c for d, c, _ in got if d in (3, 4, 9)} == {3}
    assert {f for d, _, f in got if d in (3, 4, 9)} == {"0" * 16}


def test_contamination(spark, folder):
    got = {r["doc_id"]: r for r in registry.queries()["op9_decontamination"](spark, folder[0]).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (15, 2, True)
    assert (got[2]["n_hit"], got[2]["n_items"]) == (0, 0)
    assert got[5]["n_hit"] == 15 * 3000


def test_language(spark, folder):
    got = {r["doc_id"]: r for r in registry.queries()["op10_language"](spark, folder[0]).collect()}
    assert got[1]["lang_pred"] == "en"
    assert {got[i]["lang_pred"] for i in (3, 4, 8, 9)} == {"und"}


def test_pages(spark, folder):
    got = {r["page_id"]: r for r in registry.queries()["op5_html"](spark, folder[0]).collect()}
    assert got[1]["text"] == "A & B one two" and got[3]["text"] == got[4]["text"] == ""
    assert got[6]["n_chars"] == len(LONG)
    seen = registry.queries()["op6_warc"](spark, folder[0]).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in seen if r["payload_bytes"] and r["page_id"] != 6) == [("1", "response", None), ("2", "revisit", 1), ("5", "revisit", 1), ("5", "revisit", 1), ("None", "revisit", 1)]
    assert sorted((r["page_id"], r["record_type"]) for r in seen if not r["payload_bytes"]) == [(3, "response"), (4, "revisit")]


def test_scores_without_training(spark, docs):
    model = toxicity.fit([], [])
    assert model.score(None) == model.score(EN) < 0.5
    assert langid.Identifier([], []).predict(EN) == ("und", 0.0)
    none = docs.where("false")
    tokens, grams = ppm.count_corpus(none)
    row = ppm.score(docs.where("doc_id = 4"), tokens, grams).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (1, 0, 0, 0.0)
    assert row["score"] == pytest.approx(-2.408, abs=0.001)


def test_operators_take_other_column_names(spark, docs):
    other = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("b"), F.col("lang").alias("c"), F.lit(1).alias("doc_id"), F.lit("x").alias("text"), F.lit("x").alias("lang"))
    assert simhash.near_duplicates(other, "a", "b").count() == 11
    assert packing.pack(other, packing.default_tokenizer(), "a", "b").count() >= 11
    assert divergence.verdicts(divergence.features(other, "a", "b", "c")).count() == 11
    assert pii.detect(other, "a", "b").count() == 11
    assert langid.identify(other, langid.learn(other, "a", "b", "c"), "a", "b").count() == 11
    assert decontamination.contamination(other, other, "a", "b", "a", "b").count() == 11
    page = other.select(F.col("a").alias("p"), F.col("b").alias("u"), F.col("b").alias("h"), F.lit("x").alias("url"))
    assert html_extract.extract(page, "p", "u", "h").count() == 11
    assert warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


#: Of the rows of `docs`, the ids that each stage keeps; the long text repeats the first, so their fingerprints link, and the benchmark has passages of both.
KEPT = {"language": [None, 1, 2, 5, 6, 7, 7], "near_duplicates": [1, 2, 3, 8], "decontamination": [2, 3, 4, 8, 9], "personal_data": [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, docs, folder, name, stage):
    out = stage(spark, docs, folder[0])
    ids = sorted((r["doc_id"] for r in (out.where("start = 0") if name == "packing" else out).collect()), key=lambda x: (x is not None, x))
    if name != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert ids == KEPT[name]
    else:
        assert ids == KEPT["personal_data"]
    assert stage(spark, docs.where("false"), folder[0]).count() == 0


def test_stages_pass_nulls_through(spark, folder):
    rows = spark.createDataFrame([(1, f"{EN} write to a.b@c.org", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    row = corpus_pipeline.pii_stage(spark, rows, folder[0]).first()
    assert row["text"] == f"{EN} write to [EMAIL]" and row["n_chars"] == len(row["text"]) and row["lang"] is row["source"] is None
