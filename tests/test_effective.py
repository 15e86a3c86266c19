"""Mappings of whole paths and of all paths, against the lattice in plain Python."""

import random

import pytest

from tidemark.plans import effective
from tidemark.plans.invalidate import edges
from tidemark.plans.lattice import ANYTHING, Reach, compose, join, same, trailing, window


def plain_pairs(hops):
    pairs = {}
    names = {}
    for _, b, hop in hops:
        names.setdefault(b, set()).update(hop)
    for a, b, hop in hops:
        full = {n: hop.get(n, ANYTHING) for n in names[b]}
        pairs[a, b] = join(pairs[a, b], full) if (a, b) in pairs else full
    return pairs


def plain_closure(hops, root):
    """Every path, one by one; for graphs without cycles."""
    pairs, found = plain_pairs(hops), {}

    def go(node, mapping):
        for (a, b), hop in pairs.items():
            if a == node:
                here = hop if mapping is None else compose(mapping, hop)
                found[b] = join(found[b], here) if b in found else here
                go(b, here)

    go(root, None)
    return found


def read(row):
    return Reach(row["source"], row["lo"], row["hi"], row["fine"], row["grain"]) if row["form"] == "window" else same(row["source"]) if row["form"] == "same" else ANYTHING


DAILY = {"dt": window("dt", "day"), "region": same("region")}
MONTHLY = {"dt": window("dt", "month", fine="day"), "region": same("region")}


@pytest.mark.parametrize("seed", range(2))
def test_closure_is_the_join_of_all_paths(spark, seed):
    r = random.Random(seed)
    grains = {i: "day" if i < 5 else "month" for i in range(9)}

    def hop(a, b):
        lo = r.randrange(-3, 2)
        dt = window("dt", grains[b], lo, lo + r.randrange(3), grains[a]) if r.random() < 0.9 else r.choice([ANYTHING, same("region")])
        return {"dt": dt} | ({"region": r.choice([same("region")] * 4 + [ANYTHING])} if r.random() < 0.9 else {})

    hops = [(f"t{a}", f"t{b}", hop(a, b)) for a in range(9) for b in range(a + 1, 9) for _ in range(r.choice([0, 0, 1, 1, 2]))]
    graph = edges(spark, hops)
    found = effective.closure(graph, spark.createDataFrame([("t0",), ("t3",)], "node string")).collect()
    got = {}
    for x in found:
        got.setdefault((x["root"], x["node"]), {})[x["field"]] = read(x)
    want = {(root, node): m for root in ("t0", "t3") for node, m in plain_closure(hops, root).items()}
    assert got == want


def test_along(spark):
    hops = [("raw", "silver", DAILY), ("silver", "gold", MONTHLY), ("raw", "side", DAILY), ("raw", "side", {"dt": trailing("dt", 7, "day"), "region": ANYTHING})]
    paths = spark.createDataFrame([(1, ["raw", "silver", "gold"]), (2, ["raw", "gold"]), (3, ["raw", "side"]), (4, ["raw"]), (5, ["side", "silver", "gold"]), (6, None)], "id long, path array<string>")
    got = {}
    for x in effective.along(edges(spark, hops), paths).collect():
        got.setdefault(x["id"], {})[x["field"]] = read(x)
    assert got == {
        1: compose(DAILY, MONTHLY),  # a month, and its neighbour that a widened day may be in
        2: {"dt": ANYTHING, "region": ANYTHING},  # no such hop
        3: {"dt": window("dt", "day", 0, 6), "region": ANYTHING},  # two accounts of one dependency
        5: {"dt": ANYTHING, "region": ANYTHING},
    }
    assert effective.along(edges(spark, hops), paths.where("id = 4")).count() == 0


def test_cycles_end(spark):
    hops = [("a", "b", {"dt": trailing("dt", 2, "day"), "r": same("r")}), ("b", "a", {"dt": window("dt", "day"), "r": same("r")}), ("b", "c", {"dt": window("dt", "day"), "r": same("r")})]
    found = {(x["node"], x["field"]): read(x) for x in effective.closure(edges(spark, hops), spark.createDataFrame([("a",)], "node string")).collect()}
    assert found["c", "dt"] == found["b", "dt"] == found["a", "dt"] == ANYTHING
    assert found["c", "r"] == same("r")
