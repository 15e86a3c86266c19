"""Operators against plain versions of themselves, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tests.conftest import DATA
from tidemark.llm import decontamination, html_extract, packing, pii, ppm, registry, simhash, warc
from tidemark.session import shared_dir

Q = registry.queries()


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")


def plain_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, documents):
    out = Q["op7_simhash"](spark, DATA).toPandas().set_index("doc_id").loc[documents.index]
    marks = [plain_fingerprint(t) for t in documents.text]
    assert out.fingerprint.tolist() == [f"{m:016x}" for m in marks]
    assert out.component_id.tolist() == [documents.index[i] for i in simhash.brute_components(marks)]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=60), st.integers(0, 7))
@settings(max_examples=40, deadline=None)
def test_bit_slices_count_as_popcounts(marks, radius):
    marks += [m ^ 5 for m in marks[:10]] + [m ^ (1 << 63) for m in marks[:5]]
    i, j = simhash.linked_pairs(np.array(marks, np.uint64), radius)
    want = {(a, b) for a in range(len(marks)) for b in range(a + 1, len(marks)) if (marks[a] ^ marks[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("wide", [False, True])
def test_hot_buckets_are_split_without_loss(spark, wide):
    r = random.Random(1)
    base = r.getrandbits(64)
    marks = {base ^ (1 << a) for a in range(64)} | {r.getrandbits(16) << 48 | 7 for _ in range(200)} | {r.getrandbits(64) for _ in range(100)}
    marks = sorted(marks)
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "fp long")
    links = simhash.fingerprint_links(df, bucket=16, wide=wide).collect()
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in ((x["u"] % 2**64, x["v"] % 2**64) for x in links):
        root[find(u)] = find(v)
    want = simhash.brute_components(marks)
    assert len({(find(m), w) for m, w in zip(marks, want, strict=True)}) == len(set(want)) == len({find(m) for m in marks})


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    out = Q["op8_packing"](spark, DATA).toPandas()
    for doc, g in out.groupby("doc_id"):
        ids, at = [*t.encode(documents.text[doc], add_special_tokens=False).ids, 1], 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == packing.crc_of(ids[at : at + r.length]) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= packing.WINDOW
    assert out.length.sum() > 0.97 * packing.WINDOW * out.sequence_id.nunique()


@given(st.lists(st.integers(1, 5000), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit_is_tightest(lengths):
    windows, used = packing.best_fit(lengths)
    got = Counter()
    for w, u in zip(windows, used, strict=True):
        assert sum(n for _, _, n in w) == u <= packing.WINDOW
        for item, _, n in w:
            got[item] += n
    assert got == Counter(dict(enumerate(lengths)))
    rest, open_ = sorted((n % packing.WINDOW for n in lengths if n % packing.WINDOW), reverse=True), []
    for n in rest:
        fits = [i for i, left in enumerate(open_) if left >= n]
        if fits:
            open_[min(fits, key=lambda i: open_[i])] -= n
        else:
            open_.append(packing.WINDOW - n)
    assert sorted(packing.WINDOW - left for left in open_) == sorted(u for w, u in zip(windows, used, strict=True) if w[0][2] < packing.WINDOW)


def test_encoder_equals_tokenizer():
    e, r = packing.encoder(packing.default_tokenizer()), random.Random(2)
    letters = "abcXYZ01.,;:!?'\"()-_ \n\téÉßñÇöÜ×÷ªºµſİΣς中あ<|>$%&*#`~"
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 30))) + r.choice(["", "", "<|endoftext|>", "it's", "I'LL"])
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_trie_equals_plain_ppm():
    order, r = 3, random.Random(3)
    text = lambda alphabet: [bytes(r.choice(alphabet) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 9))]
    train, test = [text(b"abcde") for _ in range(40)], [text(b"abcdefz") for _ in range(20)] + [[]]
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        raw = bytes([ppm.START]) * order + b" ".join(t) + bytes([ppm.END])
        for i in range(order, len(raw)):
            for k in range(order + 1):
                counts[k][raw[i - k : i]][raw[i]] += 1

    def log(context, s):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            seen = counts[k].get(context[order - k :])
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in excluded}
            if s in left:
                return out + math.log10(left[s] / (sum(left.values()) + len(left)))
            out += math.log10(len(left) / (sum(left.values()) + len(left))) if left else 0.0
            excluded |= set(seen)
        return out - math.log10(ppm.ALPHABET - len(excluded))

    keys = ppm._grams([b" ".join(t) for t in train], order)[0]
    levels = [np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(order + 1)]
    trie = ppm.Trie([(u, n.astype(float)) for u, n in levels])
    for t, got in zip(test, trie.score(test), strict=True):
        raw = bytes([ppm.START]) * order + b" ".join(t) + bytes([ppm.END])
        assert got == pytest.approx(sum(log(raw[i - order : i], raw[i]) for i in range(order, len(raw))), rel=1e-4)
    kept = ppm.Trie([(u[n >= 3 + k], n[n >= 3 + k].astype(float)) for k, (u, n) in enumerate(levels)])
    for context in (b"abc", b"zza", bytes([ppm.START] * 3)):
        every = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)], np.uint64)
        assert (10 ** kept.code(every)).sum() == pytest.approx(1, abs=1e-4)


def test_base_score(spark, documents):
    out = Q["op4_ppm"](spark, DATA).toPandas().set_index("doc_id")
    tokens = {i: documents.text[i].encode().lower().split() + [b""] for i in documents.index}
    c = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = out.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))


def test_base_spans(spark, documents):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    hard = ["a@b.c+d@e.f g@h", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3", "4111 1111-1111 1111 é4111111111111111", "+1 (555) 123-4567. +12 34", "x..y@z.de..w@q.r " + "1." * 50, "a" * 5000 + "@" + "b.c" * 3000]
    rows = [(int(i), t) for i, t in documents.text.items()] + [(-1 - i, t) for i, t in enumerate(hard)]
    got = {r["id"]: r["s"] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).select("id", pii.listed(pii.F.col("base")).alias("s")).collect()}

    def ok(kind, m):
        d = re.sub(r"\D", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    for i, t in rows:
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t) if ok(k, m.group())]
        assert got[i] == ",".join(want), t[:100]


def test_em_finds_the_reliable():
    r = random.Random(4)
    rows = Counter()
    for _ in range(4000):
        y = 1 if r.random() < 0.4 else -1
        rows[tuple(y if r.random() < a else -y for a in (0.95, 0.9, 0.75, 0.6))] += 1
    accuracy, prior, _ = pii.estimate([("k", v, n) for v, n in rows.items()])
    assert accuracy["k"] == pytest.approx([0.95, 0.9, 0.75, 0.6], abs=0.05) and prior["k"] == pytest.approx(0.4, abs=0.05)


def test_contamination_by_hand(spark):
    r = random.Random(5)
    word = lambda: r.choice("ab cd ef gh ij kl mn".split())
    items = [(i, " ".join(word() for _ in range(r.choice((1, 3, 12, 13, 14, 20))))) for i in range(12)]
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 60))) + " " + r.choice(items)[1].upper() + "! " + word()) for i in range(60)]
    got = {x["id"]: (x["n_words"], x["n_hit"], x["items"]) for x in decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for j, item in items:
            x = cut(item)
            n = min(13, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(j))
        assert got[i] == (len(w), len(hit), sorted(found))


def test_archives_round_trip(spark):
    from pyspark.sql import functions as F

    folder = f"{shared_dir(spark)}/archives"
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000))
    index = warc.write_archives(twice, folder, frame_bytes=20_000, bundle_bytes=200_000)
    html = {r["page_id"]: r["html"].encode() for r in pages.collect()}
    entries = index.collect()
    assert len({e["bundle"] for e in entries}) > 1 and max(e["frame"] for e in entries) > 1
    for e in entries[:60]:
        r = warc.read_record(folder, e["bundle"], e["frame"], e["offset"], e["length"])
        assert r.record_id == e["record_id"]
        page = int(r.record_id.rpartition(":")[2])
        assert (r.kind, r.payload) == (("response", html[page]) if page < 1000 else ("revisit", b""))
    records = warc.read_archives(index, folder).collect()
    assert {bytes(r["payload"]) for r in records if r["kind"] == "response"} == set(html.values())
    assert len(records) == 2 * len(html)
    path = folder.removeprefix("file://") + "/" + entries[0]["bundle"]
    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()  # noqa: SIM115
    assert whole.startswith(b"WARC/1.1")


def test_html():
    page = lambda body, ad: f'<nav><a href=x>Home</a></nav><div class="ad">{ad}</div>{body}<footer>same foot</footer>'
    a = html_extract.page_lines(page("<p>Unique one.</p><p>Read more here</p>", "x"))
    b = html_extract.page_lines(page("<p>Unique two.</p><p>Read more here</p>", "y"))
    assert html_extract.main_text(a, html_extract.keys_of(b)) == "Unique one."
    assert html_extract.main_text(a, None) == "Unique one. Read more here"
    art = html_extract.page_lines('<article><h1>T</h1><p>A<b>b</b> &lt;c&gt;<script>"</p>"</script>\n d<p>shared line<div class="comments">no</div></article>')
    assert html_extract.main_text(art, html_extract.keys_of(art)) == "T Ab <c> d shared line"
    assert html_extract.page_lines("<!-- x --><p>cut <a hre") and html_extract.page_lines("") == []


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_shared_lines_are_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(html_extract.shared_lines(a, b)) == best[-1][-1]


def test_toxicity_and_language_on_held_out(spark):
    data = "/root/testdata/sf0.01"
    lang = Q["op10_language"](spark, data).toPandas().merge(pd.read_parquet(f"{data}/documents.parquet", columns=["doc_id", "lang"]))
    held = lang[lang.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    tox = Q["op3_toxicity"](spark, data).toPandas().merge(pd.read_parquet(f"{data}/labels.parquet"))
    held = tox[tox.held_out]
    rank = held.score.rank()
    p = (held.toxic == 1).sum()
    assert (rank[held.toxic == 1].sum() - p * (p + 1) / 2) / (p * (len(held) - p)) > 0.85


def test_pipeline(spark, documents):
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), [len(documents)]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append(docs.count())
    rows = docs.toPandas().set_index("doc_id")
    alive = [i for i in documents.index if any(map(str.isalpha, documents.text[i]))]
    marks = [plain_fingerprint(documents.text[i]) for i in alive]
    first = [i for n, i in enumerate(alive) if simhash_root(marks)[n] == n]
    bad = {r["doc_id"] for r in Q["op9_decontamination"](spark, DATA).collect() if r["contaminated"]}
    assert sorted(rows.index) == sorted(set(first) - bad)
    for i in rows.index[:200]:
        if "[" not in rows.text[i]:
            assert rows.text[i] == documents.text[i]
        assert rows.n_chars[i] == len(rows.text[i])
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in rows.text)
    packed = corpus_pipeline.packing_stage(spark, docs, DATA).toPandas()
    assert set(packed.doc_id) == set(rows.index)


_ROOTS = {}


def simhash_root(marks):
    key = hashlib.md5(repr(marks).encode()).hexdigest()
    if key not in _ROOTS:
        _ROOTS[key] = simhash.brute_components(marks)
    return _ROOTS[key]


def test_dedup_stage_with_repeats(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(2, text), (1, text), (1, text), (None, text), (None, "quite other words stand here now"), (None, "quite other words stand here now")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    kept = [(r["doc_id"], r["text"][:5]) for r in corpus_pipeline.dedup_stage(spark, docs, DATA).collect()]
    assert sorted(kept, key=str) == [(1, "one t"), (None, "quite")]
