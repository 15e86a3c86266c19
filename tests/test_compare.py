"""Operators against plain versions of themselves on small inputs."""

import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import govern as v
from tidemark.operators import graph as g
from tidemark.operators import ml
from tidemark.plans.invalidate import edges, invalidate, key
from tidemark.plans.lattice import same
from tidemark.streaming import events


def closure(pairs):
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    while True:
        more = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
        if more == reach:
            return reach
        reach = more


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_reach_and_folds(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(r.randrange(25), r.randrange(25)) for _ in range(r.choice((20, 35, 50)))})
    e = spark.createDataFrame(pairs, "src long, dst long")
    below = closure(pairs)
    on = {a for a in below if a in below[a]}
    want = {a: min(b for b in on if b in below[a] and a in below[b]) for a in on}
    assert {x["node"]: x["component"] for x in g.strong_components(e).collect()} == want
    seeds = e.select(F.col("src").alias("node")).distinct()
    assert {(x["seed"], x["node"]) for x in g.reach(e, seeds).collect()} == {(a, b) for a, bs in below.items() for b in bs}
    nodes = {x for p in pairs for x in p}
    own = spark.createDataFrame([(n, n * 7 % 11) for n in nodes if n % 3], "node long, v long")
    folded = {x["node"]: x["v"] for x in g.fold_downstream(e, own, {"v": F.min}).collect()}
    above = {n: {a for a, bs in below.items() if n in bs} | {n} for n in nodes}
    assert folded == {n: min(a * 7 % 11 for a in above[n] if a % 3) for n in nodes if any(a % 3 for a in above[n])}


def test_depth_has_no_bound(spark):
    hops = [(f"t{i:03}", f"t{i + 1:03}", {"x": same("x")}) for i in range(14)]
    dirty = spark.range(1).select(F.lit("t000").alias("ds"), key(x=F.lit("a")).alias("key"))
    assert invalidate(dirty, edges(spark, hops)).count() == 15


def test_sketched_reach_is_near(spark):
    e = spark.range(1, 400).select(F.col("id").alias("src"), F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("dst")).where("dst < 800")
    exact = {x["node"]: x["n_below"] for x in g.reach_scores(e).collect()}
    near = {x["node"]: x["n_below"] for x in g.approximate_reach_scores(e).collect()}
    assert exact.keys() == near.keys() and all(abs(near[k] - n) <= 1 + 0.1 * n for k, n in exact.items())


def test_similar_sets(spark):
    r = random.Random(1)
    sets = [(i, sorted(r.sample(range(40), r.randint(1, 20)))) for i in range(60)]
    sets += [(100 + i, sorted(set(sets[i][1]) ^ {41})) for i in range(20)]
    df = spark.createDataFrame(sets, "key long, grams array<long>")
    want = {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            s = len(set(x) & set(y)) / len(set(x) | set(y))
            if s >= 0.6:
                want[min(a, b), max(a, b)] = round(s, 6)
    got = {(x["a"], x["b"]): round(x["jaccard"], 6) for x in ml.jaccard_pairs(df, 0.6).collect()}
    assert got == want


@given(st.text("abc", max_size=30), st.text("abcd", max_size=30))
@settings(max_examples=150, deadline=None)
def test_longest_shared_text(a, b):
    found = t.longest_shared(a, b)
    best = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
    assert len(found) == best and found in a and found in b


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc", "ordres", "Hi {name} and {{ name }} and {b}")], "a string, b string, n string, t string")
    row = df.select(t.line_diff("a", "b").alias("d"), t.did_you_mean(F.col("n"), ["orders", "users"]).alias("m"), t.salted_hash("a", F.lit(7)).alias("h"), t.salted_hash("a", F.lit(8)).alias("k"), t.render(F.col("t"), F.create_map(F.lit("name"), F.lit("Jo"))).alias("r"), t.longest_common("a", "b").alias("c")).first()
    assert row["d"].splitlines()[3:] == [" a", "-b", "+x", " c"] and row["m"] == "orders"
    assert 0 <= row["h"] < 1 << 61 and row["h"] != row["k"] and row["c"] is None
    assert row["r"] == "Hi Jo and Jo and {b}"


def test_quiet_alerts_on_a_stream(spark, tmp_path):
    times = [("a", 0), ("a", 50), ("a", 130), ("b", 10), ("b", 300), ("a", 250)]
    rows = spark.createDataFrame([(k, 10_000 + s) for k, s in times], "k string, s long").withColumn("at", F.timestamp_seconds("s"))
    batch = sorted((x["k"], x["sent"] - 10_000) for x in events.quiet_alerts(rows, "k", "at", 100).collect())
    assert batch == [("a", 0), ("a", 130), ("a", 250), ("b", 10), ("b", 300)]
    for i, cut in enumerate(("s < 10100", "s between 10100 and 10249", "s >= 10250")):
        rows.where(cut).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"file://{tmp_path}/in/*")
    q = events.quiet_alert_stream(stream, "k", "at", 100, "10 minutes").writeStream.format("memory").queryName("sent").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((x["fingerprint"], x["sent"] - 10_000) for x in spark.table("sent").collect()) == batch


def test_longest_chains_and_cycles(spark):
    deep = [(i, i + 1) for i in range(41)]
    e = spark.createDataFrame([*deep, (0, 40), (5, 90), (90, 41), (100, 101), (101, 102), (102, 101), (102, 103), (7, 103), (200, 200)], "src long, dst long")
    w = spark.createDataFrame([(i, 2 if i % 2 else 3) for i in range(41)] + [(41, 1)], "node long, weight long")
    got = {x["node"]: (x["level"], x["length"], x["before"]) for x in g.longest(e, w).collect()}
    weight = lambda i: 2 if i % 2 else 3
    for i in range(41):
        assert got[i] == (i, sum(map(weight, range(i + 1))), i - 1 if i else None)
    assert got[41] == (41, got[40][1] + 1, 40) and got[90] == (6, got[5][1], 5) and got[100] == (0, 0, None)
    assert set(got) == {*range(42), 90, 100}  # nothing on or behind the cycle, and no loop by itself
    assert [x["node"] for x in g.critical_path(e, w).orderBy("length").collect()] == list(range(42))


def test_labels_confirmed_and_unattributed(spark):
    labels = spark.createDataFrame([("a", "x", "pii", 0.8, False), ("b", "y", "pii", 0.3, True), ("a", "k", "id", 0.6, False)], "ds string, col string, label string, confidence double, confirmed boolean")
    columns = spark.createDataFrame([("a", "x", "b", "y"), ("b", "y", "c", "z"), ("a", None, "d", None), ("d", "q", "e", "r"), ("e", "s", "a", "x")], "src string, src_col string, dst string, dst_col string")
    got = {(x["ds"], x["col"], x["label"]): (x["confidence"], x["confirmed"]) for x in v.propagate_labels(labels, columns).collect()}
    assert got["b", "y", "pii"] == (0.3, True)  # what people said stays, although 0.76 arrives
    assert got["c", "z", "pii"] == (0.285, False)
    assert got["d", "*", "pii"] == (0.76, False) and got["d", "*", "id"] == (0.57, False)
    assert got["e", "*", "pii"] == (0.722, False)  # goes on over an edge with columns
    assert got["a", "*", "pii"] == (0.6859, False) and ("e", "r", "pii") not in got
    policies = spark.createDataFrame([("b", "pii"), ("c", "pii")], "ds string, forbid string")
    assert {(x["ds"], x["col"]) for x in v.violations(v.propagate_labels(labels, columns), policies).collect()} == {("b", "y"), ("b", "*"), ("c", "*")}
