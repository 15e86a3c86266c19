"""Which partitions of every downstream table a set of dirty partitions makes stale.

Keys are arrays of (name, any, value) in name order: `any` stands for every
value, a null value for the null partition, and times are written as
yyyy-MM-dd HH:mm:ss. The frontier of dirty keys is joined with the edges hop by
hop, and each key's images come from column expressions, so a plan of any number
of keys stays a DataFrame; only table names and round counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import cycle_core, cyclic_nodes
from tidemark.plans.lattice import MAX_KEYS, Hop
from tidemark.session import Growing, materialize

PART = "struct<name:string,any:boolean,value:string>"
KEY = f"array<{PART}>"
EDGE = "src string, dst string, fields array<struct<name:string,form:string,source:string,lo:int,hi:int,grain:string,fine:string>>"
#: Hops that one round takes.
HOPS = 6
#: Rounds in which a table on a cycle may gain keys; after that what reaches it makes all of it stale.
CYCLE_ROUNDS = 4


def edges(spark: SparkSession, hops: Iterable[tuple[str, str, Hop]]) -> DataFrame:
    """Edges as rows; each hop maps every field of the output table."""
    rows = [(a, b, [(n, r.form, r.source, r.lo, r.hi, r.grain, r.fine) for n, r in sorted(hop.items())]) for a, b, hop in hops]
    return spark.createDataFrame(rows, EDGE)


def key(**values: Column | None) -> Column:
    """A key column from named value columns; None stands for any value."""
    parts = [F.struct(F.lit(n).alias("name"), F.lit(v is None).alias("any"), (F.lit(None) if v is None else v).cast("string").alias("value")) for n, v in sorted(values.items())]
    return F.array(*parts).cast(KEY)


def stamp(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that stands in the plan once."""
    return F.get(F.transform(F.array(value), body), 0)


def _values(field: Column, k: Column) -> Column:
    """All parts that one output field can take for a dirty key."""
    name, grain = field["name"], field["grain"]
    anything = F.array(F.struct(name.alias("name"), F.lit(True).alias("any"), F.lit(None).cast("string").alias("value"))).cast(KEY)
    part = lambda v: F.struct(name.alias("name"), F.lit(False).alias("any"), v.alias("value"))
    of = lambda g, n: F.when(grain == g, n).otherwise(0)
    steps = lambda n: F.make_interval(years=of("year", n), months=of("month", n), days=of("day", n), hours=of("hour", n))
    time = lambda hit: F.call_function("date_trunc", grain, F.try_to_timestamp(hit["value"], F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")
    buckets = lambda one: F.when(one.isNull(), anything).otherwise(F.transform(F.sequence(one + steps(field["lo"]), one + steps(field["hi"]), steps(F.lit(1))), lambda b: part(stamp(b))).cast(KEY))
    bound = lambda hit: F.when(field["form"] == "same", F.array(part(hit["value"])).cast(KEY)).otherwise(_let(time(hit), buckets))
    free = lambda hit: hit.isNull() | hit["any"] | (field["form"] == "any")
    return _let(F.get(F.filter(k, lambda p: p["name"] == field["source"]), 0), lambda hit: F.when(free(hit), anything).otherwise(bound(hit)))


def images(fields: Column, k: Column, max_keys: int = MAX_KEYS) -> Column:
    """Every output key of a dirty key, as an array of keys; never none.

    While there would be more than `max_keys`, the field with the most values
    becomes unconstrained.
    """
    choices = F.transform(fields, lambda f: _values(f, k))
    count = lambda cs: F.aggregate(cs, F.lit(1).cast("long"), lambda n, c: n * F.size(c))

    def collapse(cs: Column, _: Column) -> Column:
        widest = F.array_max(F.transform(cs, lambda c: F.size(c)))
        first = F.array_position(F.transform(cs, lambda c: F.size(c)), widest)
        freed = F.transform(cs, lambda c, i: F.when(i + 1 == first, F.array(F.struct(F.get(c, 0)["name"].alias("name"), F.lit(True).alias("any"), F.lit(None).cast("string").alias("value"))).cast(KEY)).otherwise(c))
        return F.when(count(cs) > max_keys, freed).otherwise(cs)

    bounded = F.aggregate(fields, choices, collapse)
    seed = F.array(F.array().cast(KEY)).cast(f"array<{KEY}>")
    return F.aggregate(bounded, seed, lambda keys, c: F.flatten(F.transform(keys, lambda head: F.transform(c, lambda p: F.concat(head, F.array(p))))))


def subsumes(outer: Column, inner: Column) -> Column:
    """Whether every partition that `inner` names is named by `outer`: fields in the same order."""
    return F.forall(F.zip_with(outer, inner, lambda o, i: F.coalesce(o["any"], F.lit(True)) | (~F.coalesce(i["any"], F.lit(True)) & o["value"].eqNullSafe(i["value"]))), lambda x: x)


def shown(k: Column) -> Column:
    """name=value, comma-joined; * for any value, NULL for the null partition."""
    return F.array_join(F.transform(k, lambda p: F.concat(p["name"], F.lit("="), F.when(p["any"], F.lit("*")).otherwise(F.coalesce(p["value"], F.lit("NULL"))))), ",")


def _whole(k: Column) -> Column:
    return F.transform(k, lambda p: F.struct(p["name"].alias("name"), F.lit(True).alias("any"), F.lit(None).cast("string").alias("value"))).cast(KEY)


def invalidate(dirty: DataFrame, graph: DataFrame) -> DataFrame:
    """(ds, key, hops) of every stale partition, the dirty ones included: no key that another of its table subsumes.

    A round takes HOPS hops and appends the keys that are new. Rounds go on until nothing
    new is stale, however deep the graph. Tables that can reach themselves might
    gain keys for ever, so each that is still gaining after CYCLE_ROUNDS rounds is made stale as a whole, and passes that on.
    """
    graph = materialize(graph, "graph")
    seen = Growing(dirty.select("ds", "key").distinct().withColumn("hops", F.lit(0)), "stale")
    front, hops, rounds, cyclic = seen.read(), 0, 0, None
    image = F.explode(images(F.col("fields"), F.col("key"))).alias("key")
    while not front.isEmpty():
        rounds += 1
        at, every = front.select("ds", "key"), None
        for _ in range(HOPS):
            hops += 1
            # Written, not chained: keys of a hop are made once.
            at = materialize(at.join(graph, F.col("ds") == F.col("src")).select(F.col("dst").alias("ds"), image).distinct(), "reached")
            step = at.withColumn("hops", F.lit(hops))
            every = step if every is None else every.unionByName(step)
            if at.isEmpty():
                break
        reached = every.groupBy("ds", "key").agg(F.min("hops").alias("hops"))
        if rounds > CYCLE_ROUNDS:
            if cyclic is None:
                core = cycle_core(graph)  # a deep graph without cycles ends here
                loops = graph.where("src = dst").select(F.col("src").alias("node"))
                on = loops if core.isEmpty() else cyclic_nodes(core).unionByName(loops)
                cyclic = materialize(on.distinct().select(F.col("node").alias("ds"), F.lit(True).alias("on")), "cyclic")
            reached = reached.join(cyclic, "ds", "left").select("ds", F.when(F.col("on"), _whole(F.col("key"))).otherwise(F.col("key")).alias("key"), "hops").groupBy("ds", "key").agg(F.min("hops").alias("hops"))
        front = seen.append(_unseen(reached, seen.read()))
    return _antichain(seen.read())


def _wide(df: DataFrame) -> DataFrame:
    return df.where(F.exists("key", lambda p: p["any"]))


def _covered(keys: DataFrame, by: DataFrame) -> DataFrame:
    """(ds, key) of the keys that a wildcard key of `by`, other than themselves, names too.

    A wildcard key of a table is met by the keys that agree with it where it has values: freed
    where it is free, they are equal to it. The sets of free fields are few, so this joins by equality.
    """
    wide = _wide(by).select("ds", "key").distinct()
    free = lambda k: F.transform(k, lambda p: p["any"])
    masks = wide.select("ds", free(F.col("key")).alias("mask")).distinct()
    blank = lambda p: F.struct(p["name"].alias("name"), F.lit(True).alias("any"), F.lit(None).cast("string").alias("value"))
    freed = F.zip_with("key", "mask", lambda p, m: F.when(m, blank(p)).otherwise(p)).cast(KEY)
    loose = keys.select("ds", "key").distinct().join(masks, "ds").select("ds", "key", freed.alias("freed")).where("key <> freed")
    return loose.join(wide.select("ds", F.col("key").alias("freed")), ["ds", "freed"], "left_semi").select("ds", "key").distinct()


def _unseen(new: DataFrame, seen: DataFrame) -> DataFrame:
    """Keys of `new` that no seen key subsumes."""
    left = new.join(seen.select("ds", "key"), ["ds", "key"], "left_anti")
    return left.join(_covered(left, seen), ["ds", "key"], "left_anti")


def _antichain(keys: DataFrame) -> DataFrame:
    least = materialize(keys.groupBy("ds", "key").agg(F.min("hops").alias("hops")), "stale-keys")
    return least.join(_covered(least, least), ["ds", "key"], "left_anti")
