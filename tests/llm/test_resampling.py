"""Importance resampling against plain versions and its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from tidemark.llm import resampling

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TEXTS = st.lists(st.none() | st.text("aZ0 .é\n", max_size=40) | st.builds(lambda n, c: c * n, st.integers(60, 200), st.sampled_from("qé")), max_size=6)


def plain(texts, max_n, buckets=97):
    out = []
    for row, text in enumerate(texts):
        words = WORD.findall((text or "").encode().lower())
        for n in range(1, max_n + 1):
            out += [(row, n == 1, zlib.crc32(b" ".join(words[i : i + n])) % buckets) for i in range(len(words) - n + 1)]
    return Counter(out)


@given(TEXTS, st.integers(1, 3), st.integers(1, 70), st.integers(0, 2))
@settings(max_examples=300, deadline=None)
def test_features(texts, max_n, block, skip):
    column = pa.array(texts, pa.string())[skip:]
    got = Counter()
    for row, single, bucket in resampling.features(column, max_n, 97, block):
        got.update(zip(row.tolist(), single.tolist(), bucket.tolist(), strict=True))
    assert got == plain(texts[skip:], max_n)


def test_same_rows_as_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rel = duck.sql(resampling.ORACLE_SQL["op12_resampling"])
    got = resampling.op12_resampling(spark, DATA)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[c] for c in rel.columns)) for r in got.collect())


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, "w " * 20 + f"b{i % 3} " * (i % 5)) for i in range(40)] + [(7, "w " * 25)] * 3 + [(None, "w " * 30), (100, None), (101, ""), (102, "x " * 19), (103, "é" * 500_000 + " a" * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as weight", "3 as rank", "4 as _range")


def test_cases(spark, edges, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 7)
    target = spark.createDataFrame([("b1 b1 W",), (None,)], "text string")
    got = resampling.resample(edges, target).collect()
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    words = [WORD.findall((t or "").encode().lower()) for _, t in rows]
    s, t = Counter(zlib.crc32(w) % 10_000 for x in words for w in x), Counter(zlib.crc32(w) % 10_000 for w in (b"b1", b"b1", b"w"))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = []
    for (doc, _), x in zip(rows, words, strict=True):
        weight = sum(gain(zlib.crc32(w) % 10_000) for w in x)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        want.append((doc, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    n = 10 * len(able) // 100
    assert sorted((r["rank"], r["id"]) for r in got if r["rank"]) == [(i + 1, x[0]) for i, x in enumerate(able[:n])]
    assert sorted(map(str, want)) == sorted(str((r["id"], r["n_features"], r["weight"], r["score"])) for r in got)


def test_empty(spark, edges):
    none = edges.where("false")
    assert resampling.resample(none, none).count() == 0
    assert resampling.resample(edges, none.select("text")).count() == edges.count()
