"""Whole tables and long texts: what a cap, a cut or a missing case would lose."""

import random
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import divergence, html_extract, packing, pii, ppm, registry


def test_score_uses_every_gram(spark):
    r = random.Random(5)
    train = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=60_000))) for i in range(16)]
    test = [(100 + i, t[:3000] + "".join(r.choices("abcxyzé ", k=500))) for i, (_, t) in enumerate(train[:4])]
    docs = spark.createDataFrame(train, "doc_id long, text string")
    tokens, grams = ppm.count_corpus(docs)
    assert grams.count() > 600_000  # more than the workers hold
    got = {r["id"]: r["score"] for r in ppm.score(docs.unionByName(spark.createDataFrame(test, docs.schema)), tokens, grams).collect()}
    keys = ppm._grams([b" ".join(ppm.tokens_of(t)) for _, t in train], ppm.ORDER)[0]
    levels = [np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(ppm.ORDER + 1)]
    want = ppm.Trie([(u, n.astype(float)) for u, n in levels]).score([ppm.tokens_of(t) for _, t in train + test])
    assert [got[i] for i, _ in train + test] == pytest.approx(want.tolist(), rel=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 40])
def test_neighbours_across_partitions(spark, n):
    r = random.Random(n)
    sites = [f"<p>chrome of {h}</p><p>menu {h} {k}</p>" for h in "ab" for k in range(3)]
    pages = [(i, f"http://{site[13]}/{i % 7}/{i:03}", f"{site}<p>Own text {i}.</p>") for i, site in ((i, r.choice(sites)) for i in range(n))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = []
        for parts in (1, 9, 60):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append(sorted(map(tuple, html_extract.extract(df).collect())))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    classes = {}
    for i, u, h in pages:
        lines = [x for x in html_extract.page_lines(h) if x.zone != "chrome"]
        key = (u.split("/")[2], h)
        classes[key] = min(classes.get(key, ("~",)), (u.split("/", 3)[3], lines), key=lambda x: x[0])
    whole = sorted((host, path, h, lines) for (host, h), (path, lines) in classes.items())
    text = {}
    for at, x in enumerate(whole):
        near = [y for y in (*whole[max(at - 1, 0) : at], *whole[at + 1 : at + 2]) if y[0] == x[0]]
        near.sort(key=lambda y: -html_extract._closeness(y[1], x[1]))
        text[x[0], x[2]] = html_extract.main_text(x[3], *(html_extract.keys_of(y[3]) for y in near))
    assert got == [sorted((i, u, text[u.split("/")[2], h]) for i, u, h in pages)] * 3


SITE = "<div><p>Acme daily</p><p>Sign in</p><p>{menu}</p></div>{body}<div><p>All rights reserved</p><p>Made by Acme</p></div>"


def _site(n):
    """Pages without an article: one template, own sentences, and a licence line that two pages share."""
    words = [f"Sentence {i} of its own." for i in range(n)]
    extra = lambda i: "<p>Licensed to all.</p>" if i in (3, n - 1) else ""
    pages = [(i, f"https://acme.example/news/{i:03}", SITE.format(menu="Home News", body=f"<h1>Title {i}</h1><p>{w}</p>{extra(i)}")) for i, w in enumerate(words)]
    return pages, {i: f"Title {i} {w}{' Licensed to all.' if extra(i) else ''}" for i, w in enumerate(words)}


def test_differencing_decides_pages_without_an_article(spark):
    pages, want = _site(40)
    got = {r["id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == want
    alone = {i: html_extract.main_text(html_extract.page_lines(h)) for i, _, h in pages}
    assert sum(alone[i] != got[i] for i in got) == 40


def test_copies_keep_their_text(spark):
    pages, want = _site(6)
    rows = [*pages, *pages, (0, "https://acme.example/news/000?print", pages[0][2]), (0, "https://acme.example/zzz", pages[0][2])]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert len(got) == len(rows) and all(r["text"] == want[r["id"]] for r in got)
    same = [(i, f"http://h/{i}", "<p>only this</p>") for i in range(3)]
    assert {r["text"] for r in html_extract.extract(spark.createDataFrame(same, "page_id string, url string, html string")).collect()} == {"only this"}


def test_near_copies_need_a_second_word():
    keys = lambda x: html_extract.keys_of(html_extract.page_lines(x))
    page = lambda own, date: SITE.format(menu="Home", body=f"<p>{own}</p><p>{date}</p>")
    a, near, other = page("The whole story, told at length.", "Monday"), page("The whole story, told at length.", "Tuesday"), page("Something else.", "Friday")
    assert html_extract.main_text(html_extract.page_lines(a), keys(near), keys(other)) == "The whole story, told at length. Monday"


def test_names_that_hint_and_names_that_say():
    page = lambda body: html_extract.page_lines(f"<article>{body}</article>")
    kept = page('<div class="entry-header"><p>Lead.</p></div><section id="related-work"><p>Others did.</p></section><p class="notice-board">Read on.</p>')
    assert html_extract.main_text(kept) == "Lead. Others did. Read on."
    assert html_extract.main_text(kept, html_extract.keys_of(page("<p>Lead.</p>"))) == "Others did. Read on."
    assert html_extract.main_text(page('<p>Text.</p><div class="comments-area"><p>First!</p></div><div id="ad-slot-3">Buy</div><p class="related-posts"><a href=x>More like this</a></p>')) == "Text."


@pytest.mark.parametrize("html", ["<div>", "<b>", "<p><div><b>", "<li><dt><b>", "</p><i>", "<a '>", '<a ">'])
def test_nesting_costs_no_more_than_its_length(html):
    began = time.perf_counter()
    html_extract.page_lines(html * 20_000 + "end")
    once = time.perf_counter() - began
    began = time.perf_counter()
    html_extract.page_lines(html * 80_000 + "end")
    assert time.perf_counter() - began < 12 * once + 0.5


def _longest(a, b):
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
        above = row
    return above[-1]


def test_shared_lines_that_repeat_often():
    a = [x for k in range(65) for x in (f"s{k}", "x")]
    assert len(html_extract.shared_lines(a, ["x"] * 35 + a)) == 130
    r = random.Random(6)
    for letters in ("ab", "abc", "abcdefghijkl"):
        a, b = r.choices(letters, k=400), r.choices(letters + "z", k=370)
        got = sorted(html_extract.shared_lines(a, b))
        rest = iter(b)
        assert all(a[i] in rest for i in got) and len(got) == _longest(a, b)


def test_many_spans_in_one_text(spark):
    def seconds(n):
        text = " ".join(f"user{i}@mail{i % 7}.com +1 555 123 {i % 9000 + 1000}" for i in range(n))
        began = time.perf_counter()
        row = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep=("text",)).select("spans", pii.redacted(F.col("text"), F.col("spans")).alias("r")).first()
        assert len(row["spans"]) == 2 * n and row["r"] == " ".join(["[EMAIL] [PHONE]"] * n)
        assert [text[x["start"] : x["end"]] for x in row["spans"][:n]] == [f"user{i}@mail{i % 7}.com" for i in range(n)]
        return time.perf_counter() - began

    seconds(10)
    once = seconds(5_000)
    assert seconds(20_000) < 8 * once + 2


def test_redaction_equals_a_plain_one(spark):
    r = random.Random(7)
    rows = []
    for i in range(200):
        text = "".join(r.choices("abc é中\n😀", k=r.choice((0, 5, 600, 3000))))
        starts = sorted(r.randrange(len(text)) for _ in range(r.randint(0, 12))) if text else []
        spans = [(x, min(len(text), x + r.randint(1, 700)), r.choice(("email", "ip"))) for x in starts]
        r.shuffle(spans)
        rows.append((i, text, spans))
    got = {x["i"]: x["r"] for x in spark.createDataFrame(rows, "i int, text string, s array<struct<start:int,end:int,kind:string>>").select("i", pii.redacted(F.col("text"), F.col("s")).alias("r")).collect()}
    for i, text, spans in rows:
        at, out = 0, ""
        for start, end, kind in sorted(spans):
            if start >= at:
                out += f"{text[at:start]}[{kind.upper()}]"
            at = max(at, end)
        assert got[i] == out + text[at:], (text, spans)


def test_spans_that_only_the_classifier_takes(spark):
    prose = "the river runs on and on past the old mill 2019 and version 12.4 of the order 123456"
    texts = {
        "secret": "password=b7db7aa4a5fcc78305", "phone": "call 555-123-4567", "iban": "IBAN DE89 3704 0044 0532 0130 00", "ssn": "ssn 123-45-6789", "email": "mail a.b@c.org", "card": "card 4111 1111 1111 1111", "ip": "host 10.0.0.1",
        None: "see 4111 1111 1111 1112 and 300.1.1.1 and well-known-side-effects-of-this and ISBN 000-00-0000",
    }
    rows = [(i, f"{prose} {t} {prose}", k) for i, (k, t) in enumerate(list(texts.items()) * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = pii.detect(df, keep=("text", "kind")).collect()
    for r in got:
        found = {(x["kind"], r["text"][x["start"] : x["end"]]) for x in r["spans"]}
        want = texts[r["kind"]]
        assert {k for k, _ in found} == ({r["kind"]} if r["kind"] else set()), (r["kind"], found)
        assert all(t in want for _, t in found)


def test_long_texts_are_coded_in_slices(monkeypatch):
    r = random.Random(8)
    texts = [" ".join("".join(r.choices("abcdé", k=r.randint(1, 30))) for _ in range(r.randint(0, 300))) + r.choice(["", "  \n "]) for _ in range(30)] + ["", None, "x" * 5000, "   "]
    plain = [(b" ".join(ppm.tokens_of(t)), ppm.tokens_of(t)) for t in texts]
    monkeypatch.setattr(ppm, "_BLOCK", 64)
    for order in (0, 3, 6):
        body, tokens = [b""] * len(texts), [[] for _ in texts]
        for i, words, before, part in ppm._units(texts, order):
            assert before == (bytes([ppm.START]) * order + body[i])[-order:] or not order
            body[i] += part
            tokens[i] += words
        assert [(x[:-1], t) for x, t in zip(body, tokens, strict=True)] == plain


def test_words_are_judged_by_length_and_by_known_languages(spark):
    r = random.Random(9)
    common = divergence.COMMON_WORDS["en"].split()
    word = lambda: "".join(r.choices("bcdfghklmnprst", k=r.randint(3, 8)))
    prose = lambda n: " ".join(r.choice(common) if r.random() < 0.27 else word() for _ in range(n))
    greek = lambda n: " ".join("".join(r.choices("αβγδεζηθικλμνξοπρστυφχψω", k=r.randint(2, 9))) for _ in range(n))
    rows = [(i, prose(r.choice((60, 200, 900))), "en") for i in range(60)]
    rows += [(100, " ".join(word() for _ in range(10_000)), "en"), (101, " ".join(word() for _ in range(500)), None), (102, greek(300), "el"), (103, greek(300), None), (104, prose(300), "de"), (105, prose(300), None), (106, "!!! ??? " * 200, "en")]
    got = {x["id"]: x for x in divergence.verdicts(divergence.features(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    assert all(got[i]["kept"] for i in (*range(60), 102, 104, 105))
    assert not any(got[i]["kept"] for i in (100, 101, 103, 106))
    assert got[100]["word_distance"] > divergence.MAX_LONG_WORD_DISTANCE and got[102]["word_distance"] is None


def test_other_tokenizers_are_not_cut_at_spaces():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  spaces and\na line", "", " lead", "été 123!"]
    assert packing.cuts_at_space(packing.default_tokenizer()) and not packing.cuts_at_space(path)
    plain = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(path).encode(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]


def test_archives_take_text_ids(spark, tmp_path):
    pages = spark.createDataFrame([("a b", "http://h/1", "<p>x"), ("c", "http://h/2", "<p>x"), ("d", "http://h/3", None)], "page_id string, url string, html string")
    pages.write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in registry.queries()["op6_warc"](spark, f"file://{tmp_path}").collect()}
    assert got["a b"] == ("response", None) and got["c"] == ("revisit", "a b") and got["d"] == ("response", None)
