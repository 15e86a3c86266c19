"""Near copies in groups: what meets, and what is found."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import ml


def _hashed(spark, sets):
    df = spark.createDataFrame(sets, "key long, grams array<long>")
    return df.select("key", F.array_sort(F.transform("grams", lambda g: F.xxhash64(g))).alias("grams"))


def test_near_copies_take_few_links(spark):
    """minhash_clusters: two groups of near copies and a chain through which only its neighbours are alike"""
    sets = [(1000 * g + i, [*range(1000 * g, 1000 * g + 200), 10**6 + 1000 * g + i]) for g in range(2) for i in range(150)]
    sets += [(5000 + i, list(range(10**7 + 20 * i, 10**7 + 20 * i + 300))) for i in range(30)]
    df = _hashed(spark, sets)
    links = [tuple(r) for r in ml.lsh_links(df, 32, 4, 0.8).collect()]
    assert len(links) < 1500 and all(j >= 0.8 for _, _, j in links)
    none = spark.createDataFrame([], "key long, first long")
    found = {r["node"]: r["component"] for r in ml.clusters(ml.lsh_links(df, 32, 4, 0.8), none).collect()}
    assert found == {k: k // 1000 * 1000 for k, _ in sets}


def test_minhash_estimates_similarity(spark):
    df = _hashed(spark, [(0, list(range(1000))), (1, list(range(200, 1200))), (2, [7]), (3, [])])
    s = {r["key"]: np.array(r["signature"]) for r in ml.minhash(df, 256).collect()}
    assert abs((s[0] == s[1]).mean() - 2 / 3) < 0.12 and len(s[3]) == 256


def test_grams_are_those_of_the_text(spark):
    df = spark.createDataFrame([("",), (None,), (" \t",), ("a",), ("A b, c d",), ("İstanbul x\ty\n\x0bz ",), ("a b a b a b a b a b",), ("é é _x-y",), ("...",)], "text string")
    grams = F.array_distinct(t.ngrams(t.words(t.normalize(F.col("text"))), 5))
    rows = df.select(t.words(t.normalize(F.col("text"))).alias("old"), t.normal_words(F.col("text")).alias("new"), F.coalesce(F.size(grams), F.lit(0)).alias("n"), t.gram_hashes(t.normal_words(F.col("text")), 5).alias("g")).collect()
    assert all(r["old"] == r["new"] and r["n"] in (len(r["g"]), -1) and r["g"] == sorted(set(r["g"])) for r in rows if r["old"] is not None)


def test_few_grams_of_a_set_are_shuffled(spark, monkeypatch):
    """exact_jaccard_pairs: a fifth of each set, without what half of them have, and no pair lost"""
    monkeypatch.setattr(ml, "LEAST_COMMON", 2, raising=False)
    sets = [(i, [*range(100 * (i % 2)), *range(1000 * i, 1000 * i + 150)]) for i in range(1, 21)]
    sets += [(100 + k, [*g[:-5], -k]) for k, g in sets]
    df = _hashed(spark, sets)
    rows = ml._prefixes(df, 0.8).collect()
    assert len(rows) == sum(len(g) - -(-len(g) * 4 // 5) + 1 for _, g in sets)
    half = {r[0] for r in spark.range(100).select(F.xxhash64("id")).collect()}
    assert not half & {r["gram"] for r in rows}
    assert {(r["a"], r["b"]) for r in ml.jaccard_pairs(df, 0.8).collect()} == {(k, 100 + k) for k in range(1, 21)}


def _shuffled(spark, work):
    """Bytes that stages shuffle while `work` runs, and what it returns."""
    store = spark.sparkContext._jsc.sc().statusStore()
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    out = work()
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    stages = {i for j in jobs for i in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(store.lastStageAttempt(i).shuffleWriteBytes() for i in stages), out


def test_sets_are_not_shuffled_with_each_pair(spark, tmp_path):
    """exact_jaccard_pairs: 1770 pairs of 60 sets, as where no table is small enough to be broadcast"""
    _hashed(spark, [(k, [*range(1000), -k - 1]) for k in range(60)]).coalesce(2).write.parquet(f"{tmp_path}/sets")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent, out = _shuffled(spark, lambda: ml.jaccard_pairs(spark.read.parquet(f"{tmp_path}/sets"), 0.8).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(out) == 1770 and {r["jaccard"] for r in out} == {1000 / 1002}
    assert sent < 4 * 60 * 1001 * 8


def test_rare_grams_are_counted_where_they_are(spark, tmp_path):
    """exact_jaccard_pairs: only prefixes of unlike sets are shuffled"""
    _hashed(spark, [(k, list(range(2000 * k, 2000 * k + 2000))) for k in range(100)]).coalesce(2).write.parquet(f"{tmp_path}/sets")
    sent, out = _shuffled(spark, lambda: ml.jaccard_pairs(spark.read.parquet(f"{tmp_path}/sets"), 0.8).collect())
    assert not out and sent < 100 * 2000 * 8


def test_pieces_of_groups_lose_no_pair(spark, monkeypatch):
    """exact_jaccard_pairs: groups cut in many pieces, lists of keys too long to be told, against all pairs"""
    draw = np.random.default_rng(7)
    sets = {}
    for g in range(6):
        own = [int(x) for x in draw.integers(0, 10**12, 40 * (g + 1))]
        for i in range(25):
            some = draw.random(len(own)) < 0.93
            sets[100 * g + i] = sorted({*(x for x, y in zip(own, some, strict=True) if y), *(int(x) for x in draw.integers(0, 10**12, g)), own[0]})
    sets |= {1000 + i: list(range(20 * i, 20 * i + 150)) for i in range(30)} | {2000 + k: sets[k] for k in range(0, 25)}
    df = spark.createDataFrame(list(sets.items()), "key long, grams array<long>")
    like = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    expected = {(a, b): like(sets[a], sets[b]) for a in sets for b in sets if a < b < 2000 and like(sets[a], sets[b]) >= 0.8}
    assert len(expected) > 1000
    for few in (4_000_000, 0):
        for size in (1_000_000, 300):
            for name, value in (("FEW_KEYS", few), ("FEW_ENDS", few), ("PAIRS", size), ("GRAMS", size), ("COUNTED", size), ("LEAST_COMMON", 2)):
                monkeypatch.setattr(ml, name, value, raising=False)
            least, members = ml.set_classes(df)
            firsts = {r["key"]: r["first"] for r in members.collect()}
            assert {k: firsts[k] for k in firsts if k >= 2000} == {2000 + k: firsts.get(k, k) for k in range(25)}
            found = {(r["a"], r["b"]): r["jaccard"] for r in ml.jaccard_pairs(least, 0.8).collect()}
            assert found == {(a, b): j for (a, b), j in expected.items() if not {a, b} & {*firsts}}
