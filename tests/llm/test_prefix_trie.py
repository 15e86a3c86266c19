"""The conversation trie against a plain dictionary of prefixes and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.llm import prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain_trie(convs, size):
    """Nodes of {conv_id: tuple of turns}."""
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * size(p[-1]) if p else 0
        below[p] = (sum(below[c][0] for c in children[p]) or 1, own + sum(below[c][1] for c in children[p]))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if convs[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def plain_rebuild(turns):
    """turns: {conv_id: list of turns in order}."""
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    return out


@given(st.lists(st.lists(st.integers(0, 3), max_size=6).map(tuple), min_size=1, max_size=25, unique=True))
@settings(max_examples=200, deadline=None)
def test_multikey(seqs):
    rows = [(list(s), [x + 1 for x in s], 1, i, hashlib.sha256(str(i).encode()).hexdigest()) for i, s in enumerate(seqs)]
    got = prefix_trie.multikey(rows, 0, None)
    assert sorted(str(tuple(x)) for x in got) == plain_trie(dict(enumerate(seqs)), lambda t: t + 1)


def conversations():
    r = random.Random(5)
    rows = []
    for c in range(150):  # one prefix of 60 turns under many; copies; a long one
        shared = [("user", f"same {i}") for i in range(60)] if c % 3 else []
        tail = [(r.choice(["user", None]), r.choice(["a", "bé", "", None])) for _ in range(c % 7)]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(shared + tail)]
    rows += [(c, i, "user", f"copy {i}") for c in range(1000, 1060) for i in range(3)]
    rows += [(205, i, "user", f"{i % 9}") for i in range(1500)]
    rows += [(300, None, "x", "first"), (300, 0, "x", "second"), (301, 5, "b", "t"), (301, 5, "a", "t"), (301, 5, "a", "t"), (None, 1, "user", "lost"), (302, 0, None, None)]
    return rows


@pytest.mark.parametrize("local", [4, 40, 10_000])
def test_same_as_plain(spark, local):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("id", "seq", "bucket", "digit", "n", "len")})
    held = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        if c is not None:
            held[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    want = plain_trie(plain_rebuild({c: [x[1] for x in sorted(v)] for c, v in held.items()}), lambda t: len(t[1]))
    got = prefix_trie.trie(prefix_trie.rebuild(prefix_trie.encode_turns(df)), local).collect()
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in got) == want


def test_ends_in_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = spark.range(-50, 200).selectExpr("encode(cast(id % 2 as string), 'utf-8') as key", "id as conv_id")
    got = {bytes(r["key"]): r["ends"] for r in prefix_trie.ends(rows).collect()}
    for k in (0, 1):
        ids = [i for i in range(-50, 200) if abs(i) % 2 == k]
        if k:
            ids = [i for i in ids if i > 0]
        assert got[str(k).encode()] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_empty_and_turnless(spark):
    kind = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], kind)
    assert prefix_trie.trie(prefix_trie.rebuild(prefix_trie.encode_turns(none))).count() == 0
    short = next(c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6 > 2)  # its only turn goes, and its family has no first
    one = spark.createDataFrame([(short, 0, "user", "gone")], kind)
    assert [tuple(r) for r in prefix_trie.trie(prefix_trie.rebuild(prefix_trie.encode_turns(one))).select(*COLUMNS).collect()] == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_same_rows_as_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    rel = duck.sql(prefix_trie.ORACLE_SQL["op13_prefix_trie"])
    got = prefix_trie.op13_prefix_trie(spark, DATA)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[c] for c in rel.columns)) for r in got.collect())
