"""Graph queries. The graph is a rule on part keys: each part feeds its double, that plus one, and its triple."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graph as g
from tidemark.plans import effective, history
from tidemark.session import many, shared_dir, shuffled
from tidemark.suites import long, table


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("src"))
    out = F.array(F.col("src") * 2, F.col("src") * 2 + 1, F.col("src") * 3)
    e = p.select("src", F.explode(out).alias("dst")).where("src <> dst").distinct()
    return e.join(shuffled(p.select(F.col("src").alias("dst")), many(p)), "dst", "left_semi").select("src", "dst")


def cycle_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Nations in rings by region, and each ring's first nation to its region's number + 100."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    from pyspark.sql import Window as W

    w = W.partitionBy("r").orderBy("k")
    ring = n.select(F.col("k").alias("src"), F.coalesce(F.lead("k").over(w), F.min("k").over(W.partitionBy("r"))).alias("dst"))
    return ring.unionByName(n.groupBy("r").agg(F.min("k").alias("src")).select("src", (F.col("r") + 100).alias("dst")))


def _seeds(spark: SparkSession, *nodes: int) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def mapped_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The part graph with mappings: parts from 64 on are monthly, the others daily; every fourth part's edges are known twice."""
    grain = lambda k: F.when(k < 64, "day").otherwise("month")
    none, src, dst = F.lit(None).cast("string"), F.col("src"), F.col("dst")
    part = lambda name, form, source, lo, hi, g, fine: F.struct(F.lit(name).alias("name"), form.alias("form"), source.alias("source"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), g.alias("grain"), fine.alias("fine"))
    free = dst % 5 == 0
    region = part("region", F.when(free, "any").otherwise("same"), F.when(~free, "region"), F.lit(0), F.lit(0), none, none)
    dt = lambda lo: part("dt", F.lit("window"), F.lit("dt"), lo, dst % 3, grain(dst), grain(src))
    e = part_edges(spark, sf)
    once = e.select("src", "dst", F.array(dt(-(src % 2)), region).alias("fields"))
    return once.unionByName(e.where(dst % 4 == 0).select("src", "dst", F.array(dt(-(src % 2) - 1), region).alias("fields")))


def effective_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """How partitions of two parts reach all parts below them, over every path."""
    return effective.closure(mapped_edges(spark, sf), _seeds(spark, 1, 5)).select("root", "node", "field", *effective.VALUE)


def path_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """What the path to each part from the part of a quarter of its key implies; an odd one out has no such path."""
    k = F.col("p_partkey")
    paths = table(spark, sf, "part").where(k >= 8).select(k.alias("id"), F.array(F.floor(k / 4), F.when(k % 7 == 0, k).otherwise(F.floor(k / 2)), k).alias("path"))
    return effective.along(mapped_edges(spark, sf), paths).select("id", "field", *effective.VALUE)


def bfs_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return g.reach(part_edges(spark, sf), _seeds(spark, 1, 7)).select("seed", "node", long("depth").alias("depth"))


def bfs_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return g.reach(part_edges(spark, sf), _seeds(spark, 192, 150), upstream=True).select("seed", "node", long("depth").alias("depth"))


def bfs_limited(spark: SparkSession, sf: str) -> DataFrame:
    return g.reach(part_edges(spark, sf), _seeds(spark, 1), max_depth=3).select("node", long("depth").alias("depth"))


def roots_leaves(spark: SparkSession, sf: str) -> DataFrame:
    e = part_edges(spark, sf)
    return g.roots(e).withColumn("kind", F.lit("root")).unionByName(g.leaves(e).withColumn("kind", F.lit("leaf")))


def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return g.degrees(part_edges(spark, sf))


def level_depths(spark: SparkSession, sf: str) -> DataFrame:
    return g.levels(part_edges(spark, sf)).select("node", long("level").alias("level"))


def shortest_distance(spark: SparkSession, sf: str) -> DataFrame:
    return g.shortest_path(part_edges(spark, sf), 1, 144).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), long(F.size("path") - 1).alias("distance"))


def simple_paths(spark: SparkSession, sf: str) -> DataFrame:
    return g.simple_paths(part_edges(spark, sf), 1, 72).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def reach_scores(spark: SparkSession, sf: str) -> DataFrame:
    return g.reach_scores(part_edges(spark, sf))


def most_depended_on(spark: SparkSession, sf: str) -> DataFrame:
    return g.top(g.reach_scores(part_edges(spark, sf)), "n_below", "node", 10)


def lowest_common_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return g.common_ancestors(part_edges(spark, sf), 96, 144).select("node", long("distance").alias("distance"))


def weak_components(spark: SparkSession, sf: str) -> DataFrame:
    return g.weak_components(cycle_edges(spark, sf))


def strong_components(spark: SparkSession, sf: str) -> DataFrame:
    return g.strong_components(cycle_edges(spark, sf))


def graph_diff(spark: SparkSession, sf: str) -> DataFrame:
    e = part_edges(spark, sf).withColumn("evidence", (F.col("src") + F.col("dst")) % 7)
    after = e.where("src % 11 <> 0").withColumn("evidence", F.when(F.col("src") % 13 == 0, -1).otherwise(F.col("evidence")))
    new = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey").cast("long") + 100_000).alias("dst"), F.lit(0).cast("long").alias("evidence"))
    return g.diff(e, after.unionByName(new), ["src", "dst"], "evidence")


def freshness_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest build (a rule on keys) among a part and all that it is made from."""
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 37 % 101).alias("built"))
    return g.fold_downstream(part_edges(spark, sf), own, {"built": F.min}).select("node", F.col("built").alias("oldest"))


def ring_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Two rings of 100 of the orders' remainders, the second fed by the first, and a tail of parts behind them."""
    k = table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("k")).distinct()
    first = k.select(F.col("k").alias("src"), ((F.col("k") + 1) % 100).alias("dst"))
    second = k.select((F.col("k") + 200).alias("src"), ((F.col("k") + 37) % 100 + 200).alias("dst"))
    tail = table(spark, sf, "part").select((F.col("p_partkey") + 1000).alias("dst"), (F.col("p_partkey") % 100 + 200).alias("src"))
    return first.unionByName(second).unionByName(spark.createDataFrame([(5, 205)], "src long, dst long")).unionByName(tail)


def long_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Strong components with cycles of 100 nodes."""
    return g.strong_components(ring_edges(spark, sf))


def chain_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of a chain of 100 nodes, each of which feeds two parts."""
    n = spark.range(1, 101)
    chain = n.where("id < 100").select((-F.col("id")).alias("src"), (-F.col("id") - 1).alias("dst"))
    leaves = table(spark, sf, "part").select((-(F.col("p_partkey") % 100 + 1)).alias("src"), F.col("p_partkey").alias("dst"))
    return g.levels(chain.unionByName(leaves)).select("node", long("level").alias("level"))


def _minutes(spark: SparkSession, sf: str) -> DataFrame:
    """How long each part takes to build."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("weight"))


def longest_chains(spark: SparkSession, sf: str) -> DataFrame:
    """The heaviest chain of builds up to every part."""
    return g.longest(part_edges(spark, sf), _minutes(spark, sf)).select("node", long("level").alias("level"), "length")


def critical_path(spark: SparkSession, sf: str) -> DataFrame:
    """What no parallelism shortens: the heaviest chain of all."""
    return g.critical_path(part_edges(spark, sf), _minutes(spark, sf))


def node_heights(spark: SparkSession, sf: str) -> DataFrame:
    return g.heights(part_edges(spark, sf)).select("node", long("height").alias("height"))


def build_slack(spark: SparkSession, sf: str) -> DataFrame:
    return g.slack(part_edges(spark, sf), _minutes(spark, sf))


def bottleneck_parts(spark: SparkSession, sf: str) -> DataFrame:
    return g.bottlenecks(part_edges(spark, sf), 10)


def _recorded(spark: SparkSession, sf: str) -> str:
    """The folder of a history: part edges day by day, each day without every eleventh and with every thirteenth of them mapped anew; the fourth day's graph is the third's."""
    path = f"{shared_dir(spark)}/tidemark/history-{uuid.uuid4().hex}"
    e = part_edges(spark, sf)
    parent = None
    for k in (0, 1, 2, 2):
        value = F.when((F.col("src") + k) % 13 == 0, F.lit(f"new{k}")).otherwise("old")
        row = history.record(spark, path, e.where((F.col("src") + k) % 11 != 0).select("src", "dst", value.alias("value")), f"2024-01-0{k + 1} 00:00:00", parent=parent)
        parent = row["digest"]
    return path


def graph_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """How many edges of each mapping a recorded graph had at moments before, between and at its revisions."""
    at = F.explode(F.array(*[F.to_timestamp(F.lit(t)) for t in ("2023-12-31 00:00:00", "2024-01-01 00:00:00", "2024-01-02 12:00:00", "2024-01-09 00:00:00")])).alias("at")
    held = history.as_of(spark, _recorded(spark, sf), spark.range(1).select(at))
    return held.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), "value").agg(F.count("*").alias("n"), F.sum(F.col("src").cast("long") * F.col("dst").cast("long")).alias("mark"))


def revision_log(spark: SparkSession, sf: str) -> DataFrame:
    return history.revisions(spark, _recorded(spark, sf)).select("number", "added", "removed", "changed")


_NAMES = (bfs_descendants, bfs_ancestors, bfs_limited, roots_leaves, node_degrees, level_depths, shortest_distance, simple_paths, reach_scores, most_depended_on, lowest_common_ancestors, weak_components, strong_components, graph_diff, graph_as_of, revision_log, freshness_fold, effective_mappings, path_mappings, longest_chains, critical_path, node_heights, build_slack, bottleneck_parts, long_rings, chain_levels)
QUERIES = {f.__name__: f for f in _NAMES}

_E = """e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, unnest([p_partkey * 2, p_partkey * 2 + 1, p_partkey * 3]) AS dst FROM part)
  WHERE src <> dst AND dst IN (SELECT p_partkey FROM part){more})"""
_ALL = _E.format(more="")
_RING = """e AS (
  SELECT n_nationkey::BIGINT AS src, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey))::BIGINT AS dst FROM nation
  UNION ALL SELECT min(n_nationkey)::BIGINT, n_regionkey::BIGINT + 100 FROM nation GROUP BY n_regionkey)"""
_DOWN = "r AS (SELECT seed, seed AS node, 0::BIGINT AS depth FROM (VALUES {seeds}) s(seed) UNION SELECT r.seed, {to}, depth + 1 FROM r JOIN e ON e.{at} = r.node{limit})"


def _reach(seeds: str, up: bool = False, limit: str = "") -> str:
    return _DOWN.format(seeds=seeds, to="e.src" if up else "e.dst", at="dst" if up else "src", limit=limit)


_CLOSURE = "r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst)"
ORACLE_SQL = {
    "bfs_descendants": f"WITH RECURSIVE {_ALL}, {_reach('(1), (7)')} SELECT seed::BIGINT AS seed, node::BIGINT AS node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY 1, 2",
    "bfs_ancestors": f"WITH RECURSIVE {_ALL}, {_reach('(192), (150)', up=True)} SELECT seed::BIGINT AS seed, node::BIGINT AS node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY 1, 2",
    "bfs_limited": f"WITH RECURSIVE {_ALL}, {_reach('(1)', limit=' WHERE depth < 3')} SELECT node::BIGINT AS node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY 1",
    "roots_leaves": f"WITH {_ALL} SELECT DISTINCT src AS node, 'root' AS kind FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT DISTINCT dst, 'leaf' FROM e WHERE dst NOT IN (SELECT src FROM e)",
    "node_degrees": f"WITH {_ALL} SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node",
    "level_depths": f"""WITH RECURSIVE {_ALL}, l AS (SELECT DISTINCT src AS node, 0::BIGINT AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM l JOIN e ON e.src = l.node)
SELECT node, max(level) AS level FROM l GROUP BY node""",
    "shortest_distance": f"""WITH RECURSIVE {_ALL}, r AS (SELECT [1::BIGINT] AS p UNION ALL SELECT list_append(p, e.dst) FROM r JOIN e ON e.src = p[-1] WHERE len(p) <= 8 AND p[-1] <> 144)
SELECT array_to_string(p, '>') AS path, (len(p) - 1)::BIGINT AS distance FROM r WHERE p[-1] = 144 ORDER BY len(p), p LIMIT 1""",
    "simple_paths": f"""WITH RECURSIVE {_ALL}, r AS (SELECT [1::BIGINT] AS p UNION ALL SELECT list_append(p, e.dst) FROM r JOIN e ON e.src = p[-1] WHERE len(p) <= 12 AND p[-1] <> 72)
SELECT array_to_string(p, '>') AS path FROM r WHERE p[-1] = 72""",
    "reach_scores": f"WITH RECURSIVE {_ALL}, {_CLOSURE} SELECT src AS node, count(*) AS n_below FROM r GROUP BY 1",
    "most_depended_on": f"WITH RECURSIVE {_ALL}, {_CLOSURE} SELECT src AS node, count(*) AS n_below FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "lowest_common_ancestors": f"""WITH RECURSIVE {_ALL}, {_reach('(96), (144)', up=True)}, m AS (SELECT seed, node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY 1, 2)
SELECT node::BIGINT AS node, sum(depth)::BIGINT AS distance FROM m GROUP BY node HAVING count(DISTINCT seed) = 2""",
    "weak_components": "SELECT n_nationkey::BIGINT AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey)::BIGINT AS component FROM nation UNION ALL SELECT n_regionkey::BIGINT + 100, min(n_nationkey)::BIGINT FROM nation GROUP BY n_regionkey",
    "strong_components": "SELECT n_nationkey::BIGINT AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey)::BIGINT AS component FROM nation",
    "graph_diff": f"""WITH {_ALL} SELECT src, dst, CASE WHEN src % 11 = 0 THEN 'removed' ELSE 'changed' END AS change FROM e WHERE src % 11 = 0 OR src % 13 = 0
UNION ALL SELECT n_regionkey::BIGINT, n_nationkey::BIGINT + 100000, 'added' FROM nation""",
    "freshness_fold": f"""WITH RECURSIVE {_ALL}, {_CLOSURE}, a AS (SELECT dst AS node, src AS source FROM r UNION SELECT p_partkey, p_partkey FROM part)
SELECT node, min(source * 37 % 101)::BIGINT AS oldest FROM a GROUP BY node""",
}
ORACLE_SQL |= {
    "long_rings": "SELECT DISTINCT o_orderkey % 100 AS node, 0::BIGINT AS component FROM orders UNION ALL SELECT DISTINCT o_orderkey % 100 + 200, 200 FROM orders",
    "chain_levels": "SELECT -i AS node, i - 1 AS level FROM range(1, 101) t(i) UNION ALL SELECT p_partkey, p_partkey % 100 + 1 FROM part",
}
ORACLE_SQL["schedule_waves"] = ORACLE_SQL["level_depths"].replace("SELECT node, max(level) AS level FROM l GROUP BY node", "SELECT level AS wave, count(*) AS n_nodes FROM (SELECT node, max(level) AS level FROM l GROUP BY node) GROUP BY 1")
_WEIGHTED = f"""WITH RECURSIVE {_ALL}, w AS (SELECT p_partkey AS node, p_size::BIGINT AS weight FROM part),
top AS (SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)), leaf AS (SELECT DISTINCT dst AS node FROM e WHERE dst NOT IN (SELECT src FROM e)),
l AS (SELECT node, 0::BIGINT AS level, weight AS length FROM top JOIN w USING (node) UNION SELECT e.dst, level + 1, length + weight FROM l JOIN e ON e.src = l.node JOIN w ON w.node = e.dst),
b AS (SELECT node, weight AS tail FROM leaf JOIN w USING (node) UNION SELECT e.src, tail + weight FROM b JOIN e ON e.dst = b.node JOIN w ON w.node = e.src),
d AS (SELECT node, max(level) AS level, max(length) AS length FROM l GROUP BY node)"""
_MAPPED = f"""WITH RECURSIVE {_ALL},
m AS (SELECT src, dst, -(src % 2) - CASE WHEN dst % 4 = 0 THEN 1 ELSE 0 END AS lo, dst % 3 AS hi, CASE WHEN src < 64 THEN 'day' ELSE 'month' END AS fine, CASE WHEN dst < 64 THEN 'day' ELSE 'month' END AS grain, dst % 5 <> 0 AS region FROM e)"""
_THROUGH = """CASE WHEN {r}.grain = m.grain THEN {r}.lo WHEN {r}.lo >= 0 THEN 0 ELSE -(ceil(-{r}.lo / 28)::BIGINT + 1) END + m.lo AS lo,
  CASE WHEN {r}.grain = m.grain THEN {r}.hi ELSE CASE WHEN {r}.hi <= 0 THEN 0 ELSE ceil({r}.hi / 28)::BIGINT + 1 END + 1 END + m.hi AS hi"""
ORACLE_SQL |= {
    "longest_chains": f"{_WEIGHTED} SELECT node, level, length FROM d",
    "critical_path": f"""{_WEIGHTED}, c AS (
  SELECT node, length FROM (SELECT node, length FROM d ORDER BY length DESC, node LIMIT 1)
  UNION ALL SELECT (x).node, (x).length FROM (SELECT (SELECT min(struct_pack(minus := -d.length, node := d.node, length := d.length)) FROM e JOIN d ON d.node = e.src WHERE e.dst = c.node) AS x FROM c) WHERE x IS NOT NULL)
SELECT node, length FROM c""",
    "node_heights": f"WITH RECURSIVE {_ALL}, b AS (SELECT DISTINCT dst AS node, 0::BIGINT AS height FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, height + 1 FROM b JOIN e ON e.dst = b.node) SELECT node, max(height) AS height FROM b GROUP BY node",
    "build_slack": f"{_WEIGHTED}, t AS (SELECT node, max(tail) AS tail FROM b GROUP BY node) SELECT node, (SELECT max(length) FROM d) - length - tail + weight AS slack FROM d JOIN t USING (node) JOIN w USING (node)",
    "bottleneck_parts": f"WITH RECURSIVE {_ALL}, {_CLOSURE}, x AS (SELECT src AS node, count(*) AS down FROM r GROUP BY 1), y AS (SELECT dst AS node, count(*) AS up FROM r GROUP BY 1) SELECT node, down * up AS n_pairs FROM x JOIN y USING (node) ORDER BY 2 DESC, 1 LIMIT 10",
    "effective_mappings": f"""{_MAPPED}, r AS (SELECT src AS root, dst AS node, lo, hi, grain, region FROM m WHERE src IN (1, 5)
  UNION SELECT root, m.dst, {_THROUGH.format(r="r")}, m.grain, r.region AND m.region FROM r JOIN m ON m.src = r.node)
SELECT root, node, 'dt' AS field, 'window' AS form, 'dt' AS source, 'day' AS fine, grain, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi FROM r GROUP BY root, node, grain
UNION ALL SELECT root, node, 'region', CASE WHEN bool_and(region) THEN 'same' ELSE 'any' END, CASE WHEN bool_and(region) THEN 'region' END, NULL, NULL, 0, 0 FROM r GROUP BY root, node""",
    "path_mappings": f"""{_MAPPED}, p AS (SELECT p_partkey AS id, p_partkey // 4 AS a, CASE WHEN p_partkey % 7 = 0 THEN p_partkey ELSE p_partkey // 2 END AS b FROM part WHERE p_partkey >= 8),
x AS (SELECT id, f.fine, m.grain, {_THROUGH.format(r="f")}, f.region AND m.region AS region FROM p JOIN m f ON f.src = a AND f.dst = b JOIN m ON m.src = b AND m.dst = id)
SELECT id, 'dt' AS field, CASE WHEN x.id IS NULL THEN 'any' ELSE 'window' END AS form, CASE WHEN x.id IS NOT NULL THEN 'dt' END AS source, fine, grain, coalesce(lo, 0)::BIGINT AS lo, coalesce(hi, 0)::BIGINT AS hi FROM p LEFT JOIN x USING (id)
UNION ALL SELECT id, 'region', CASE WHEN region THEN 'same' ELSE 'any' END, CASE WHEN region THEN 'region' END, NULL, NULL, 0, 0 FROM p LEFT JOIN x USING (id)""",
}
_REVISED = _ALL + """, h AS (SELECT k, src, dst, CASE WHEN (src + k) % 13 = 0 THEN 'new' || k ELSE 'old' END AS value FROM e, (VALUES (0), (1), (2)) r(k) WHERE (src + k) % 11 <> 0)"""
ORACLE_SQL |= {
    "graph_as_of": f"WITH {_REVISED} SELECT day, value, count(*) AS n, sum(src * dst)::BIGINT AS mark FROM h JOIN (VALUES (0, '2024-01-01'), (1, '2024-01-02'), (2, '2024-01-09')) d(k, day) USING (k) GROUP BY ALL",
    "revision_log": f"""WITH {_REVISED}, x AS (SELECT coalesce(a.k + 1, b.k) AS number, a.value AS had, b.value AS value FROM (SELECT * FROM h WHERE k < 2) a FULL JOIN h b ON a.k + 1 = b.k AND a.src = b.src AND a.dst = b.dst)
SELECT number::BIGINT AS number, count(*) FILTER (had IS NULL) AS added, count(*) FILTER (value IS NULL) AS removed, count(*) FILTER (value <> had) AS changed FROM x GROUP BY 1""",
}
