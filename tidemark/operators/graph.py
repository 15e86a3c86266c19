"""Graph operators on an edge table (src, dst): frontier loops of joins, never a path per row pair.

A round joins only the newly reached nodes with the edges, a few hops at a time,
and drops what was seen, so cycles end by themselves; what it found is appended
to a table in the shared folder. Loops end when nothing new is reached, at any
depth, unless the caller asks for a bound. Few edges are broadcast; many meet the
nodes in shuffled hash joins, whatever the size of their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.components import connected_components
from tidemark.session import Growing, many, materialize, shuffled

#: Hops that one round takes before what it reached is written.
HOPS = 6


def _hops(edges: DataFrame, upstream: bool = False) -> DataFrame:
    a, b = ("dst", "src") if upstream else ("src", "dst")
    return edges.select(F.col(a).alias("from"), F.col(b).alias("to")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, upstream: bool = False) -> DataFrame:
    """(seed, node, depth): every node that a seed reaches, within `max_depth` hops if given, and its least distance; a seed appears if it is on a cycle.

    seeds has one column, `node`.
    """
    hop = materialize(_hops(edges, upstream), "hops")
    front = seeds.select(F.col("node").alias("seed"), "node").distinct()
    far, dense = many(hop), False
    if far:
        front = materialize(front, "seeds")
        dense = many(front)
    found, depth = None, 0
    while max_depth is None or depth < max_depth:
        steps, at = [], front
        for _ in range(HOPS if max_depth is None else min(HOPS, max_depth - depth)):
            depth += 1
            at = shuffled(at, far and not dense).join(shuffled(hop, far and dense), F.col("node") == F.col("from")).select("seed", F.col("to").alias("node"))
            # One shuffle by node serves both this and the next join.
            at = (at.repartition("node") if dense else at).distinct()
            steps.append(at.withColumn("depth", F.lit(depth)))
        step = steps[0]
        for more in steps[1:]:
            step = step.unionByName(more)
        if found is None:
            found = Growing(step.groupBy("seed", "node").agg(F.min("depth").alias("depth")), "reached")
            new = found.read()
        else:
            # Depths only grow, so a pair that was found before has its least depth already.
            both = step.unionByName(found.read().select("seed", "node", F.lit(0).alias("depth"))).groupBy("seed", "node").agg(F.min("depth").alias("depth"))
            new = found.append(both.where("depth > 0"))
        front = new.where(F.col("depth") == depth).select("seed", "node")
        if front.isEmpty():
            break
    return found.read() if found is not None else front.withColumn("depth", F.lit(0)).where("false")


def spread(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(label, node) of the marks and of all that is downstream of each; marks has label and node."""
    hop = materialize(_hops(edges), "hops")
    far = many(hop)
    found = Growing(marks.select("label", "node").distinct(), "marks")
    front = found.read()
    while not front.isEmpty():
        every, at = None, front
        for _ in range(HOPS):
            at = shuffled(at, far).join(hop, F.col("node") == F.col("from")).select("label", F.col("to").alias("node")).distinct()
            every = at if every is None else every.unionByName(at)
        both = every.withColumn("new", F.lit(True)).unionByName(found.read().withColumn("new", F.lit(False)))
        front = found.append(both.groupBy("label", "node").agg(F.bool_and("new").alias("new")).where("new"))
    return found.read()


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) over distinct neighbours."""
    e = edges.select("src", "dst").distinct()
    out = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    return out.unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))).groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


#: Rounds after which a search for longest chains looks for cycles, which would keep it going for ever.
CYCLE_CHECK = 4


def longest(edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(node, level, length, before): the longest chains from roots, by edges and by weight, and the node before on the heaviest one.

    weights has node and weight, 0 where missing; without it every node weighs 1. Ties go to the
    least node. Nodes on or behind a cycle have no row: in a deep graph what cycles there are is found by
    trimming, from both ends, all that lies on none, unless all edges go one way in the order of nodes. What was
    folded before stays: nothing that is not behind a cycle depends on what is.
    """
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    weigh = (lambda df: df.withColumn("weight", F.lit(1).cast("long"))) if weights is None else (lambda df: df.join(weights.select("node", F.col("weight").cast("long").alias("weight")), "node", "left").fillna(0, ["weight"]))
    none = F.lit(None).cast(e.schema["src"].dataType)
    steps = materialize(weigh(e.select(F.col("src").alias("from"), F.col("dst").alias("node"))).withColumnRenamed("node", "to"), "hops")
    own = weigh(roots(e)).select("node", F.lit(0).alias("level"), F.struct((-F.col("weight")).alias("minus"), none.alias("before")).alias("best"))
    onward = {"level": F.col("level") + 1, "best": F.struct((F.col("best.minus") - F.col("weight")).alias("minus"), F.col("from").alias("before"))}
    combine = {"level": F.max, "best": F.min}
    fold = _Fold(steps, own, combine, onward)
    if not fold.settle(CYCLE_CHECK):
        core = e.where("false") if one_way(e) else cycle_core(e)
        if not core.isEmpty():
            on = core.select(F.col("src").alias("node")).union(core.select(F.col("dst").alias("node"))).distinct()
            fold.drop(materialize(spread(e, on.select(F.lit(0).alias("label"), "node")).select("node").distinct(), "behind-cycles"))
        fold.settle()
    return fold.values().select("node", "level", (-F.col("best.minus")).alias("length"), F.col("best.before").alias("before"))


def one_way(edges: DataFrame) -> bool:
    """Whether all edges go up, or all go down, in the order of nodes, so that none is on a cycle but loops."""
    ways = edges.agg(F.max(F.col("src") < F.col("dst")).alias("up"), F.max(F.col("src") > F.col("dst")).alias("down")).first()
    return not (ways["up"] and ways["down"])


def cycle_core(edges: DataFrame) -> DataFrame:
    """(src, dst) of the edges on cycles or between them; each round drops the ends of chains, a few edges deep."""
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "core")
    n = e.count()
    while n:
        e = materialize(_trimmed(e), "core")
        had, n = n, e.count()
        if n == had:
            break
    return e


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a root; nodes on or behind a cycle have none."""
    return longest(edges).select("node", "level")


def heights(edges: DataFrame) -> DataFrame:
    """(node, height): the longest path to a leaf; nodes on or before a cycle have none."""
    return levels(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("level", "height")


def critical_path(edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(node, length): the heaviest chain, each node with the weight up to it; of equally heavy ones the one that ends at the least node.

    Walked back over the stored predecessors, several of them a round.
    """
    chains = materialize(longest(edges, weights), "chains")
    last = chains.orderBy(F.desc("length"), F.asc("node")).limit(1).select("node")
    above = reach(chains.where("before is not null").select(F.col("before").alias("src"), F.col("node").alias("dst")), last, upstream=True)
    return chains.join(above.select("node").unionByName(last), "node", "left_semi").select("node", "length")


def slack(edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(node, slack): by how much a node may grow before the heaviest chain does."""
    down = materialize(longest(edges, weights).select("node", "length"), "chains")
    back = longest(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), weights).select("node", F.col("length").alias("tail"))
    whole = down.agg(F.max("length").alias("whole"))
    weight = F.lit(1) if weights is None else F.coalesce("weight", F.lit(0))
    both = down.join(back, "node")
    both = both if weights is None else both.join(weights.select("node", "weight"), "node", "left")
    return both.crossJoin(F.broadcast(whole)).select("node", (F.col("whole") - F.col("length") - F.col("tail") + weight).alias("slack"))


def shortest_path(edges: DataFrame, start: object, end: object, max_depth: int | None = None) -> DataFrame:
    """One row (path) or none; of equally short ones the least by node order."""
    front = edges.limit(0).select(F.array(F.col("src")).alias("path")).unionByName(edges.sparkSession.range(1).select(F.array(F.lit(start)).cast(edges.select(F.array("src")).dtypes[0][1]).alias("path")))
    seen = Growing(front.select(F.element_at("path", -1).alias("node")), "seen")
    hop = materialize(_hops(edges), "hops")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(hop, F.element_at("path", -1) == F.col("from")).select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("node"))
        step = step.join(seen.read(), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        front = materialize(step, "paths")
        hit = front.where(F.col("node") == F.lit(end))
        if not hit.isEmpty():
            return hit.select("path")
        if front.isEmpty():
            break
        seen.append(front.select("node"))
        front = front.select("path")
    return front.select("path").where("false")


def simple_paths(edges: DataFrame, start: object, end: object, max_edges: int = 12) -> DataFrame:
    """All paths without a repeated node, of at most `max_edges` edges."""
    hop = edges.select(F.col("src").alias("from"), F.col("dst").alias("to")).distinct()
    front, found = hop.where(F.col("from") == F.lit(start)).select(F.array("from", "to").alias("path")), []
    for _ in range(max_edges):
        front = materialize(front, "paths")
        if front.isEmpty():
            break
        found.append(front.where(F.element_at("path", -1) == F.lit(end)))
        front = front.where(F.element_at("path", -1) != F.lit(end)).join(hop, F.element_at("path", -1) == F.col("from")).where(~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"))
    out = found[0] if found else front.where("false")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges whose ends both have edges in and out, after a few rounds of dropping the others: none on a cycle goes."""
    e = edges
    for _ in range(rounds):
        e = e.join(e.select(F.col("dst").alias("src")), "src", "left_semi").join(e.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    return e


def _least_above(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, color): the least of the nodes that reach each, itself included."""
    known = materialize(nodes.select("node", F.col("node").alias("color")), "colors")
    front = known
    while True:
        moved, every = front, None
        for _ in range(HOPS):
            moved = moved.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("color"))
            every = moved if every is None else every.unionByName(moved)
        best = every.groupBy("node").agg(F.min("color").alias("new"))
        front = materialize(known.join(best, "node").where("new < color").select("node", F.col("new").alias("color")), "recolored")
        if front.isEmpty():
            return known
        known = materialize(known.unionByName(front).groupBy("node").agg(F.min("color").alias("color")), "colors")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles; component is the least node of the cycle's component.

    Colouring: every node takes the least node that reaches it. What a colour's
    own node is reached from inside its colour is one component, so each round
    settles one component of every colour, and never holds a pair of nodes.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    e = edges.select("src", "dst").where("src <> dst").distinct()
    e = materialize(e.where("false") if one_way(e) else _trimmed(e), "cycle-edges")
    found = Growing(loops.where("false"), "components")
    while not e.isEmpty():
        nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
        color = _least_above(e, nodes)
        inner = e.join(color.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst").where("a = b")
        back = spread(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), color.where("node = color").select(F.col("color").alias("label"), "node"))
        sizes = back.groupBy("label").agg(F.count("*").alias("n"))
        found.append(back.join(sizes.where("n > 1"), "label").select("node", F.col("label").alias("component")))
        settled = back.select("node")
        left = e.join(settled.withColumnRenamed("node", "src"), "src", "left_anti").join(settled.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        e = materialize(_trimmed(left), "cycle-edges")
    on = found.read()
    return on.unionByName(loops.join(on.select("node"), "node", "left_anti"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    return strong_components(edges).select("node")


def weak_components(edges: DataFrame) -> DataFrame:
    return connected_components(edges, "src", "dst")


def fold_downstream(edges: DataFrame, own: DataFrame, combine: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(node, and each column of combine): aggregates of the values of a node and all its ancestors.

    Aggregates must not depend on order or repetition (least, greatest, any): a
    node then needs what its parents' values fold to, not its ancestors' values.
    Each round passes on only what changed, so cycles settle too. A node
    without a value and without an ancestor that has one has no row.
    """
    fold = _Fold(_hops(edges), own.select("node", *combine), combine, {c: F.col(c) for c in combine})
    fold.settle()
    return fold.values()


class _Fold:
    """What a node and all that leads to it come to: (node, and each column of combine); hops (from, to, ...) turn values as `onward` says.

    A round carries what changed a few hops on and appends what that changes: a node's value is the
    fold of its rows, so no row is written again, and one aggregation finds what a round has changed.
    """

    def __init__(self, hops: DataFrame, own: DataFrame, combine: dict[str, Callable[[Column], Column]], onward: dict[str, Column]):
        self.combine, self.onward = combine, onward
        self.hop = materialize(hops, "hops")
        self.far = many(self.hop)
        self.known = Growing(self._fold(own), "folded")
        self.front = self.known.read()

    def _fold(self, df: DataFrame) -> DataFrame:
        return df.groupBy("node").agg(*[f(F.col(c)).alias(c) for c, f in self.combine.items()])

    def settle(self, rounds: int | None = None) -> bool:
        """Whether nothing changes any more, after at most that many rounds."""
        names = list(self.combine)
        while not self.front.isEmpty():
            if rounds == 0:
                return False
            rounds = rounds and rounds - 1
            moved, every = self.front, None
            for _ in range(HOPS):
                moved = self._fold(shuffled(moved, self.far).join(self.hop, F.col("node") == F.col("from")).select(F.col("to").alias("node"), *[v.alias(c) for c, v in self.onward.items()]))
                every = moved if every is None else every.unionByName(moved)
            both = every.withColumn("_new", F.lit(True)).unionByName(self.known.read().withColumn("_new", F.lit(False)))
            old = lambda c: F.when(~F.col("_new"), F.col(c))
            sums = both.groupBy("node").agg(*[f(F.col(c)).alias(c) for c, f in self.combine.items()], *[f(old(c)).alias(f"_{c}") for c, f in self.combine.items()], F.bool_or("_new").alias("_new"), F.bool_and("_new").alias("_first"))
            differs = F.col("_first")
            for c in names:
                differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
            self.front = self.known.append(sums.where(F.col("_new") & differs).select("node", *names))
        return True

    def drop(self, nodes: DataFrame) -> None:
        """Go on without these nodes, whose values lead to none that stays."""
        self.front = materialize(self.front.join(nodes, "node", "left_anti"), "folded")
        self.known = Growing(self.known.read().join(nodes, "node", "left_anti"), "folded")
        self.hop = materialize(self.hop.join(nodes.withColumnRenamed("node", "to"), "to", "left_anti").select(*self.hop.columns), "hops")

    def values(self) -> DataFrame:
        return self._fold(self.known.read())


def common_ancestors(edges: DataFrame, a: object, b: object) -> DataFrame:
    """(node, distance): shared ancestors by summed distance; the lowest have the least."""
    kind = edges.schema["src"].dataType
    seeds = edges.sparkSession.range(1).select(F.explode(F.array(F.lit(a).cast(kind), F.lit(b).cast(kind))).alias("node"))
    up = reach(edges, seeds, upstream=True)
    return up.groupBy("node").agg(F.sum("depth").alias("distance"), F.count_distinct("seed").alias("n")).where("n = 2").select("node", "distance")


def reach_scores(edges: DataFrame) -> DataFrame:
    """(node, n_below): how many nodes depend on each, exactly: as many pairs are held as are counted."""
    nodes = edges.select(F.col("src").alias("node")).distinct()
    return reach(edges, nodes).groupBy(F.col("seed").alias("node")).agg(F.count("*").alias("n_below"))


def approximate_reach_scores(edges: DataFrame, precision: int = 12) -> DataFrame:
    """(node, n_below) to a few per cent: sketches of what is below, folded upwards, so one sketch of fixed size for each node is all that is held."""
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    own = nodes.groupBy("node").agg(F.hll_sketch_agg(F.col("node"), precision).alias("sketch"))
    size = fold_sketches(up, own)
    on = cyclic_nodes(edges).withColumn("_on", F.lit(1))
    return size.join(on, "node", "left").select("node", (F.col("n") - F.when(F.col("_on").isNull(), 1).otherwise(0)).alias("n_below")).where("n_below > 0")


def fold_sketches(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, n): the estimate of the union of each node's sketch with all upstream."""
    return fold_downstream(edges, own.select("node", "sketch"), {"sketch": F.hll_union_agg}).select("node", F.hll_sketch_estimate("sketch").alias("n"))


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): edges added, removed, or whose `value` changed."""
    b, a = before.select(*keys, F.col(value).alias("b"), F.lit(1).alias("in_b")), after.select(*keys, F.col(value).alias("a"), F.lit(1).alias("in_a"))
    both = b.join(a, keys, "full_outer")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def top(scores: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """The n largest, ties by name."""
    return scores.orderBy(F.desc(by), F.asc(tie)).limit(n)


def bottlenecks(edges: DataFrame, n: int) -> DataFrame:
    """(node, n_pairs): the n nodes that lie between the most pairs of one above and one below, ties by node; one set of pairs gives both counts."""
    pairs = reach(edges, edges.select(F.col("src").alias("node")).distinct())
    down, up = (pairs.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(n)) for c, n in (("seed", "down"), ("node", "up")))
    return top(down.join(up, "node").select("node", (F.col("down") * F.col("up")).alias("n_pairs")), "n_pairs", "node", n)


def waves(edges: DataFrame, slowest: str = "level") -> DataFrame:
    """(wave, nodes): what can be rebuilt at once."""
    return levels(edges).groupBy(F.col("level").alias("wave")).agg(F.count("*").alias("n_nodes"))


def column_ancestry(columns: DataFrame, ds: str, col: str, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of the columns that a column is derived from; columns has src, src_col, dst, dst_col."""
    e = columns.select(F.concat_ws("#", "src", "src_col").alias("src"), F.concat_ws("#", "dst", "dst_col").alias("dst"))
    seed = columns.sparkSession.range(1).select(F.lit(f"{ds}#{col}").alias("node"))
    return reach(e, seed, max_depth, upstream=True).select("node", "depth")


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
