"""SQL lineage: exact answers, and the property that no change of a partition leaves its reach."""

import datetime
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.plans.lattice import ANYTHING, same, window
from tidemark.plans.naming import Field, parse_spec
from tidemark.sources import sqllineage
from tidemark.sources.dataflow import MOST_SPAN, Bucket

SPECS = {k: parse_spec(v) for k, v in {"s": "dt:day", "u": "dt:day, region", "m": "dt:month", "t": "dt:day", "tm": "dt:month", "silver.events": "dt:day, region", "gold.m": "dt:month, region"}.items()}
SCHEMAS = {
    "s": (("dt", "date"), ("id", "int"), ("x", "int"), ("ldt", "date")),
    "u": (("dt", "date"), ("id", "int"), ("region", "string")),
    "t": (("dt", "date"), ("x", "bigint")),
    "tm": (("dt", "date"), ("x", "bigint")),
    "gold.m": (("dt", "date"), ("region", "string"), ("v", "bigint")),
}
DAY = lambda lo, hi: window("dt", "day", lo, hi)
MONTH = lambda lo, hi: window("dt", "month", lo, hi, "day")

#: Queries that write dt, x, and how s reaches dt by day and by month.
QUERIES = {
    "SELECT dt, x FROM s": (DAY(0, 0), MONTH(0, 0)),
    "SELECT dt, x FROM s UNION ALL SELECT date_add(dt, 7) AS dt, x FROM s": (DAY(0, 7), MONTH(0, 1)),
    "SELECT a.dt, b.x FROM s a JOIN s b ON a.id = b.id": (ANYTHING, ANYTHING),
    "SELECT a.dt, b.x FROM s a JOIN s b ON a.dt = b.dt AND a.id = b.id": (DAY(0, 0), MONTH(0, 0)),
    "SELECT a.dt, b.x FROM s a, s b WHERE a.dt = b.dt": (DAY(0, 0), MONTH(0, 0)),
    "SELECT a.dt, b.x FROM s a LEFT JOIN s b ON a.dt = b.dt": (DAY(0, 0), MONTH(0, 0)),
    "SELECT b.dt, a.x FROM s a LEFT JOIN s b ON a.dt = b.dt": (ANYTHING, ANYTHING),
    "SELECT coalesce(a.dt, b.dt) AS dt, a.x FROM s a FULL JOIN s b ON a.dt = b.dt": (ANYTHING, ANYTHING),
    "SELECT u.dt, s.x FROM u LEFT JOIN s ON u.dt = date_add(s.dt, 2)": (ANYTHING, ANYTHING),
    "SELECT u.dt, s.x FROM u LEFT JOIN (SELECT date_add(dt, 2) AS dt, x FROM s) s ON u.dt = s.dt": (DAY(2, 2), MONTH(0, 1)),
    "SELECT u.dt, u.id AS x FROM u LEFT ANTI JOIN s ON u.dt = s.dt AND u.id = s.id": (DAY(0, 0), MONTH(0, 0)),
    "SELECT u.dt, u.id AS x FROM u LEFT SEMI JOIN s ON u.id = s.id": (ANYTHING, ANYTHING),
    "SELECT dt, sum(x) OVER (ORDER BY dt ROWS 6 PRECEDING) AS x FROM s": (ANYTHING, ANYTHING),
    "SELECT dt, sum(x) OVER (PARTITION BY dt ORDER BY id) AS x FROM s": (DAY(0, 0), MONTH(0, 0)),
    "SELECT dt, sum(x) OVER (ORDER BY dt RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS x FROM s": (DAY(0, 6), MONTH(0, 1)),
    "SELECT dt, sum(x) OVER (ORDER BY dt DESC RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS x FROM s": (DAY(-3, 1), MONTH(-1, 1)),
    "SELECT dt, sum(x) OVER (ORDER BY dt RANGE BETWEEN INTERVAL 1 MONTH PRECEDING AND CURRENT ROW) AS x FROM s": (DAY(0, 31), MONTH(0, 2)),
    "SELECT dt, x FROM (SELECT date_add(dt, 1) AS dt, x FROM s) q": (DAY(1, 1), MONTH(0, 1)),
    "WITH q AS (SELECT date_sub(dt, 1) AS dt, x FROM s) SELECT dt, x FROM q": (DAY(-1, -1), MONTH(-1, 0)),
    "WITH q AS (SELECT dt, x FROM s) SELECT a.dt, b.x FROM q a JOIN q b ON a.x = b.x": (ANYTHING, ANYTHING),
    "SELECT dt, x FROM s WHERE x > (SELECT avg(x) FROM s)": (ANYTHING, ANYTHING),
    "SELECT dt, id AS x FROM u WHERE id IN (SELECT id FROM s)": (ANYTHING, ANYTHING),
    "SELECT dt, id AS x FROM u WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.dt = u.dt)": (ANYTHING, ANYTHING),
    "SELECT dt, (SELECT max(x) FROM s) AS x FROM u": (ANYTHING, ANYTHING),
    "SELECT dt, sum(x) AS x FROM s GROUP BY dt": (DAY(0, 0), MONTH(0, 0)),
    "SELECT max(dt) AS dt, x FROM s GROUP BY x": (ANYTHING, ANYTHING),
    "SELECT dt, sum(x) AS x FROM s GROUP BY ROLLUP (dt)": (ANYTHING, ANYTHING),
    "SELECT date_trunc('month', dt) AS dt, sum(x) AS x FROM s GROUP BY 1": (DAY(-30, 0), MONTH(0, 0)),
    "SELECT date_add(trunc(dt, 'MM'), 40) AS dt, x FROM s": (ANYTHING, MONTH(0, 2)),
    "SELECT trunc(date_add(dt, 40), 'MM') AS dt, x FROM s": (DAY(-30, 62), MONTH(0, 2)),
    "SELECT add_months(dt, -1) AS dt, x FROM s": (DAY(-31, -28), MONTH(-2, 0)),
    "SELECT add_months(trunc(dt, 'MM'), 2) AS dt, x FROM s": (DAY(26, 62), MONTH(2, 2)),
    "SELECT dt + INTERVAL 3 DAYS AS dt, x FROM s": (DAY(3, 3), MONTH(0, 1)),
    "SELECT dt, x FROM s EXCEPT SELECT dt, x FROM (SELECT date_add(dt, 1) AS dt, x FROM s)": (DAY(0, 1), MONTH(0, 1)),
    "SELECT dt, x FROM s INTERSECT SELECT ldt, x FROM s": (ANYTHING, ANYTHING),
    "SELECT DISTINCT dt, x FROM s WHERE x % 2 = 0": (DAY(0, 0), MONTH(0, 0)),
    "SELECT dt, x FROM s ORDER BY x, dt, id, ldt LIMIT 5": (ANYTHING, ANYTHING),
    "SELECT dt, v AS x FROM s LATERAL VIEW explode(array(x, id)) t AS v": (DAY(0, 0), MONTH(0, 0)),
    "SELECT ldt AS dt, x FROM s": (ANYTHING, ANYTHING),
    "SELECT CASE WHEN x > 5 THEN dt ELSE ldt END AS dt, x FROM s": (ANYTHING, ANYTHING),
    "SELECT u.dt, q.n AS x FROM u JOIN LATERAL (SELECT count(*) AS n FROM s WHERE s.id = u.id) q": (ANYTHING, ANYTHING),
    "SELECT dt, x FROM (SELECT dt, x, row_number() OVER (PARTITION BY x ORDER BY dt, id, ldt) AS k FROM s) WHERE k = 1": (ANYTHING, ANYTHING),
}


@pytest.fixture(scope="module")
def analyzer(spark):
    return sqllineage.Analyzer(spark, SPECS, SCHEMAS)


@pytest.mark.parametrize("query", sorted(QUERIES))
def test_reaches(analyzer, query):
    for target, want in zip(("t", "tm"), QUERIES[query], strict=True):
        text = f"INSERT INTO {target} {query}"
        found = analyzer.statements(text)[0].reaches["s"]["dt"]
        assert found == want
        assert query.startswith("WITH") is False or analyzer.statements(f"WITH {query[5:].split(' SELECT dt, x FROM q')[0].split(' SELECT a.dt')[0]} INSERT INTO {target} {query[query.index(') SELECT') + 2:]}")[0].reaches["s"]["dt"] == want


def _covered(reach, dirty, found, grain):
    if reach == ANYTHING or found is None:
        return reach == ANYTHING
    index = (lambda d: d.toordinal()) if grain == "day" else (lambda d: d.year * 12 + d.month)
    return reach.lo <= index(found) - index(dirty) <= reach.hi


@pytest.mark.parametrize("query", sorted(QUERIES))
def test_no_change_leaves_the_reach(spark, query):
    """A rebuild of the reach misses nothing: rows that a dirty partition adds or takes lie inside."""
    r = random.Random(query)
    day = lambda: datetime.date(2024, 1, 20) + datetime.timedelta(r.randrange(50))
    row = lambda d: (d, r.randrange(4), r.randrange(9), day())
    rows = [row(day()) for _ in range(60)]
    other = spark.createDataFrame([(day(), r.randrange(4), r.choice("ab")) for _ in range(30)], "dt date, id int, region string")
    other.createOrReplaceTempView("u")

    def result(s):
        spark.createDataFrame(s, "dt date, id int, x int, ldt date").createOrReplaceTempView("s")
        return Counter((x["dt"].date() if isinstance(x["dt"], datetime.datetime) else x["dt"], x["x"]) for x in spark.sql(query).collect())

    before = result(rows)
    for _ in range(2):
        dirty = r.choice(rows)[0]
        after = result([x for x in rows if x[0] != dirty] + [row(dirty) for _ in range(r.randrange(3))])
        changed = {d for d, _ in (before - after) + (after - before)}
        for reach, grain in zip(QUERIES[query], ("day", "month"), strict=True):
            assert all(_covered(reach, dirty, d, grain) for d in changed), (dirty, changed)


@given(st.sampled_from(["day", "month", "year"]), st.lists(st.one_of(st.tuples(st.sampled_from(["day", "month", "year"]), st.integers(-40, 40)), st.sampled_from(["day", "month", "year"])), max_size=4), st.dates(datetime.date(1990, 1, 1), datetime.date(2050, 1, 1)))
@settings(max_examples=500, deadline=None)
def test_buckets_hold_what_steps_do(fine, steps, value):
    """Any chain of truncations and moves ends within what its bucket says, for every time in the source's partition."""

    def step(d, s):
        if isinstance(s, str):
            return d.replace(day=1, **({"month": 1} if s == "year" else {})) if s != "day" else d
        unit, n = s
        if unit == "day":
            return d + datetime.timedelta(n)
        months = d.year * 12 + d.month - 1 + n * (12 if unit == "year" else 1)
        first = datetime.date(months // 12, months % 12 + 1, 1)
        last = (datetime.date(months // 12 + (months % 12 == 11), (months + 1) % 12 + 1, 1) - datetime.timedelta(1)).day
        return first.replace(day=min(d.day, last))

    index = {"day": lambda d: d.toordinal(), "month": lambda d: d.year * 12 + d.month, "year": lambda d: d.year}
    bucket, got = Bucket("dt", fine, fine), value
    for s in steps:
        bucket = bucket.truncated(s) if isinstance(s, str) else bucket.moved(s[1], s[0])
        got = step(got, s)
    for grain in ("day", "month", "year"):
        reach = bucket.reach(grain)
        if reach != ANYTHING:
            assert reach.lo <= index[grain](got) - index[grain](value) <= reach.hi
    assert MOST_SPAN["day", "month"] == 31


def test_statements(analyzer):
    one = lambda sql: analyzer.statements(sql)[0]
    x = one("INSERT INTO t (x, dt) SELECT id, ldt FROM s")
    assert x.columns == [("s", "id", "x"), ("s", "ldt", "dt")] and x.reaches["s"]["dt"] == ANYTHING
    x = one("WITH q AS (SELECT date_add(dt, 1) AS d, x FROM s) INSERT INTO t SELECT d, x FROM q")
    assert x.columns == [("s", "dt", "dt"), ("s", "x", "x")] and x.reaches["s"]["dt"] == DAY(1, 1)
    x = one("CREATE TABLE t AS WITH q AS (SELECT date_add(dt, 1) AS dt, x FROM s) SELECT dt, x FROM q")
    assert x.reaches["s"]["dt"] == DAY(1, 1)
    x = one("INSERT INTO gold.m SELECT date_trunc('month', dt) AS dt, region, sum(amount) FROM silver.events GROUP BY 1, 2")
    assert x.columns == [("silver.events", "amount", "v"), ("silver.events", "dt", "dt"), ("silver.events", "region", "region")]
    assert x.reaches["silver.events"] == {"dt": MONTH(0, 0), "region": same("region")}
    x = one("INSERT INTO gold.m PARTITION (dt = '2024-01-01') SELECT region, x FROM s")
    assert x.reaches["s"] == {"dt": ANYTHING, "region": ANYTHING}
    x = one("INSERT INTO gold.m SELECT * FROM silver.events")  # its columns are not known
    assert x.reaches["silver.events"] == {"dt": ANYTHING, "region": ANYTHING}
    x = one("INSERT INTO nowhere SELECT dt, x FROM s")
    assert x.columns and x.reaches == {"s": {}}
    x = one("INSERT INTO t SELECT raw.events.dt, u.x FROM raw.events JOIN db.u u ON raw.events.id = u.id")
    assert x.sources == ["db.u", "raw.events"] and ("db.u", "x", "x") in x.columns
    x = one("INSERT INTO t SELECT dt, y FROM a JOIN b ON a.id = b.id")  # whose dt and y?
    assert (x.sources, x.columns, x.resolved) == (["a", "b"], [], False)
    x = one("MERGE INTO t USING s ON t.dt = s.dt WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *")
    assert x.target == "t" and x.reaches == {"s": {"dt": ANYTHING}}
    assert [y.target for y in analyzer.statements("FROM s INSERT INTO t SELECT dt, x INSERT INTO tm SELECT dt, x")] == ["t", "tm"]
    x = one("WITH s AS (SELECT * FROM u) INSERT INTO t SELECT dt, id FROM s")  # the name of a table for something else
    assert x.sources == ["u"]
    x = one("WITH s AS (SELECT * FROM s) INSERT INTO t SELECT dt, x FROM s")  # the table itself, inside
    assert x.sources == ["s"] and x.reaches["s"]["dt"] == DAY(0, 0)
    assert analyzer.statements("SELECT 1") == analyzer.statements("SELEC x") == analyzer.statements("INSERT INTO t VALUES (1, 2)") == []


def test_a_log_in_batches(spark):
    texts = [f"INSERT INTO t SELECT date_add(dt, {i}) AS dt, x FROM s" for i in range(5)] * 3 + [None, "x"]
    log = spark.createDataFrame([(t,) for t in texts], "sql string")
    edges, reaches = sqllineage.log_lineage(log, SPECS, SCHEMAS, batch=2)
    assert edges.count() == 10 and sorted(r["lo"] for r in reaches.collect()) == [0, 1, 2, 3, 4]
    assert [tuple(r) for r in sqllineage.joined(reaches).collect()] == [("t", "s", "dt", "window", "dt", "day", 0, 4)]
    assert not any(v.startswith("t") for v in [x.name for x in spark.catalog.listTables()] if v in ("t", "tm"))
    assert Field.parse("dt:day").grain == "day"
