"""What loops must not do on large tables: broadcasts by the size of files, work begun anew, two passes for one."""

import re

import pytest

from tidemark import session
from tidemark.operators import graph as g
from tidemark.plans import effective
from tidemark.plans.invalidate import edges
from tidemark.plans.lattice import same, window


@pytest.fixture
def plans(spark, monkeypatch):
    """The physical plans of what ran since, with every table taken for a large one."""
    monkeypatch.setattr(session, "FEW_ROWS", -1, raising=False)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()

    def read():
        every = store.executionsList()
        return [every.apply(i).physicalPlanDescription() for i in range(before, every.size())]

    return read


def test_closure_broadcasts_no_hops(spark, plans):
    """effective_mappings"""
    hops = [(f"t{a}", f"t{b}", {"dt": window("dt", "day", -1, 0), "region": same("region")}) for a in range(9) for b in (a + 1, a + 2)]
    found = effective.closure(edges(spark, hops), spark.createDataFrame([("t0",)], "node string")).collect()
    assert {r["lo"] for r in found if r["node"] == "t5" and r["field"] == "dt"} == {-5}
    rounds = [p for p in plans() if re.search(r"Arguments: \S*closure-\w+/part=[1-9]", p)]
    assert rounds and not [p for p in rounds if "BroadcastHashJoin" in p]


def test_deep_graph_without_cycles_is_folded_once(spark, monkeypatch):
    """chain_levels, build_slack, critical_path, node_heights"""
    monkeypatch.setattr(g, "cycle_core", lambda e: pytest.fail("searched for cycles"))
    chain = spark.range(1, 31).selectExpr("id as src", "id + 1 as dst")
    assert {r["node"]: r["level"] for r in g.levels(chain).collect()} == {i: i - 1 for i in range(1, 32)}


def test_votes_are_parted_by_their_number(spark, monkeypatch):
    """approval_states"""
    from tidemark.operators import assets

    monkeypatch.setattr(assets, "VOTES", 10, raising=False)
    requests = spark.range(100).selectExpr("id as request", "id % 3 as author")
    votes = spark.range(1000).selectExpr("id % 100 as request", "id % 7 as approver", "true as approve")
    out = assets.approved(requests, votes, 2)
    assert out.rdd.getNumPartitions() == 101 and {r["state"] for r in out.collect()} == {"approved"}


def test_one_set_of_pairs_gives_both_counts(spark, monkeypatch):
    """bottleneck_parts"""
    calls, reach = [], g.reach
    monkeypatch.setattr(g, "reach", lambda *a, **k: calls.append(1) or reach(*a, **k))
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert [tuple(r) for r in g.bottlenecks(chain, 2).collect()] == [(2, 2), (3, 2)] and len(calls) == 1


def test_events_are_parted_by_their_number(spark, monkeypatch):
    """run_column_lineage, run_lineage, run_events"""
    from tidemark.sources import lineage

    monkeypatch.setattr(lineage, "EVENTS", 10, raising=False)
    d = "array(named_struct('namespace', 'raw', 'name', 'a', 'facets', cast(null as struct<columnLineage:struct<fields:map<string,struct<inputFields:array<struct<namespace:string,name:string,field:string>>>>>>)))"
    x = "array(named_struct('namespace', 'gold', 'name', string(id % 2), 'facets', struct(struct(map('c', struct(array(struct('raw' as namespace, 'a' as name, string(id % 4) as field)) as inputFields)) as fields) as columnLineage)))"
    events = spark.range(200).selectExpr("if(id % 4 = 3, 'FAIL', 'COMPLETE') as eventType", "string(id) as eventTime", "named_struct('runId', string(id)) as run", f"{d} as inputs", f"{x} as outputs")
    out = lineage.collapse_runs(events)
    assert out.count() == 150 and out.rdd.getNumPartitions() == 21
    assert {tuple(r) for r in lineage.live_columns(events).collect()} == {("raw/a", "0", "gold/0", "c"), ("raw/a", "1", "gold/1", "c"), ("raw/a", "2", "gold/0", "c")}
