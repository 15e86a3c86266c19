"""The mapping that a whole path, or every path between two tables, implies.

Mappings are rows: one for each field of an edge, as `invalidate.edges` makes
them. Parallel edges are joined, hops are composed, and what several paths say of
one field is joined again, so a result covers each of them. Joining before composing gives
the same as composing every path, since both only move ends of windows apart; so a round passes on one
row for each pair and field, never one for each path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import LEAST_SPAN
from tidemark.operators.graph import cyclic_nodes
from tidemark.session import Growing, many, materialize, shuffled

VALUE = ("form", "source", "fine", "grain", "lo", "hi")
#: Rounds in which a field of a table on a cycle may widen; after that it is unbounded.
CYCLE_ROUNDS = 8
#: Hops that one round takes.
HOPS = 3


def _any() -> dict[str, Column]:
    return {"form": F.lit("any")} | {c: F.lit(None).cast("string") for c in ("source", "fine", "grain")} | {c: F.lit(0).cast("long") for c in ("lo", "hi")}


def _value(columns: dict[str, Column], sure: Column | None = None) -> list[Column]:
    """The six columns of a reach, unbounded where it is not sure."""
    loose = _any()
    return [(columns[c] if sure is None else F.when(sure, columns[c]).otherwise(loose[c])).alias(c) for c in VALUE]


def fields(graph: DataFrame) -> DataFrame:
    """(src, dst, field, form, source, fine, grain, lo, hi): one row for each pair of tables and field of the second, parallel edges joined.

    A field that some edge into a table names and another does not is unbounded on the other.
    """
    numbered = materialize(graph.select("src", "dst", "fields", F.monotonically_increasing_id().alias("edge")), "edges")
    rows = numbered.select("src", "dst", "edge", F.explode("fields").alias("f"))
    rows = materialize(rows.select("src", "dst", "edge", F.col("f.name").alias("field"), *[F.col(f"f.{c}").cast("long" if c in ("lo", "hi") else "string").alias(c) for c in VALUE]), "fields")
    far = many(rows)
    names = rows.select("dst", "field").distinct()
    every = rows.select("src", "dst", "edge").distinct().join(shuffled(names, far), "dst")
    held = every.join(shuffled(rows, far), ["src", "dst", "edge", "field"], "left")
    return joined(held.select("src", "dst", "field", *_value({c: F.col(c) for c in VALUE}, F.col("form").isNotNull())), ["src", "dst", "field"])


def _cover(when: Column | None = None) -> list[Column]:
    """Aggregates of the least reach that covers all rows, or those of `when`; `_covered` makes columns of it."""
    pick = (lambda c: c) if when is None else (lambda c: F.when(when, c))
    kind = F.struct(*VALUE[:4])
    return [f(pick(c)).alias(name) for f, c, name in ((F.min, kind, "least"), (F.max, kind, "most"), (F.min, F.col("lo"), "lo"), (F.max, F.col("hi"), "hi"))]


def _covered(of: str = "") -> list[Column]:
    at = (lambda c: F.col(f"{of}.{c}")) if of else F.col
    columns = {c: at("least")[c] for c in VALUE[:4]} | {c: at(c) for c in ("lo", "hi")}
    return _value(columns, at("least").eqNullSafe(at("most")))


def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One reach for each key: what covers all of them."""
    return rows.groupBy(*keys).agg(*_cover()).select(*keys, *_covered())


def composed(inner: dict[str, Column], outer: dict[str, Column]) -> list[Column]:
    """A reach seen through an earlier one; the earlier one's columns are null where it names no such field."""
    alike, least = inner["grain"] == outer["grain"], F.lit(None).cast("long")
    for pair, n in LEAST_SPAN.items():
        least = F.when((inner["grain"] == pair[0]) & (outer["grain"] == pair[1]), n).otherwise(least)
    up = lambda n: F.ceil(n / least) + 1
    wide = {
        "lo": F.when(alike, inner["lo"]).when(inner["lo"] >= 0, 0).otherwise(-up(-inner["lo"])),
        "hi": F.when(alike, inner["hi"]).when(inner["hi"] <= 0, 1).otherwise(up(inner["hi"]) + 1),
    }
    through = (outer["form"] == "window") & (inner["form"] == "window")
    sure = (outer["form"] != "any") & F.coalesce(inner["form"] != "any", F.lit(False)) & (~through | ((inner["grain"] == outer["fine"]) & (alike | least.isNotNull())))
    pick = lambda c: F.when(outer["form"] == "same", inner[c]).otherwise(outer[c])
    columns = {
        "form": pick("form"), "source": inner["source"], "fine": F.when(through, inner["fine"]).otherwise(pick("fine")), "grain": pick("grain"),
        "lo": F.when(through, wide["lo"] + outer["lo"]).otherwise(pick("lo")), "hi": F.when(through, wide["hi"] + outer["hi"]).otherwise(pick("hi")),
    }
    return _value(columns, sure)


def _hops(graph: DataFrame) -> DataFrame:
    """`fields` with the field of the source table that each looks at (`key`), null where that has no such field.

    Each pair of tables also has a row without a field and key: that the one is
    reached where the other is. So a hop is one join by node and key.
    """
    rows = materialize(fields(graph), "mapped")
    names = rows.select(F.col("dst").alias("src"), F.col("field").alias("source"), F.lit(True).alias("_there")).distinct()
    keyed = rows.join(shuffled(names, many(rows)), ["src", "source"], "left").select("src", "dst", "field", F.when(F.col("_there"), F.col("source")).alias("key"), *VALUE)
    none = F.lit(None).cast("string")
    bare = rows.select("src", "dst").distinct().select("src", "dst", none.alias("field"), none.alias("key"), *_value(_any()))
    return materialize(keyed.unionByName(bare), "hops")


def _onward(known: DataFrame, hops: DataFrame, keys: list[str], far: bool) -> DataFrame:
    """(keys, node, field, reach) one hop after `known` (keys, node, field, reach), for every field of the next table that looks at one of them."""
    held = known.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "node", "field", *VALUE)])
    both = shuffled(held, far).join(hops, (F.col("_node") == F.col("src")) & F.col("_field").eqNullSafe(F.col("key")))
    return both.select(*[F.col(f"_{k}").alias(k) for k in keys], F.col("dst").alias("node"), "field", *composed({c: F.col(f"_{c}") for c in VALUE}, {c: F.col(c) for c in VALUE}))


def closure(graph: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, field, reach): how partitions of each root (column `node`) reach each field of every table below it.

    A round passes on only pairs that widened, and ends when none did. Windows
    around a cycle might widen for ever: a field that did so in CYCLE_ROUNDS rounds is unbounded.
    """
    hops = _hops(graph)
    far = many(hops)
    keys = ["root", "node", "field"]
    first = hops.join(roots.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    known = Growing(first.select(F.col("src").alias("root"), F.col("dst").alias("node"), "field", *VALUE), "closure")
    front, cyclic, rounds = known.read(), None, 0
    while not front.isEmpty():
        rounds += 1
        moved, every = front, None
        for _ in range(HOPS):
            moved = joined(_onward(moved, hops, ["root"], far), keys)
            every = moved if every is None else every.unionByName(moved)
        both = every.withColumn("_new", F.lit(True)).unionByName(known.read().withColumn("_new", F.lit(False)))
        sums = both.groupBy(*keys).agg(*_cover(), F.struct(*_cover(~F.col("_new"))).alias("old"), F.bool_or("_new").alias("_new"), F.bool_and("_new").alias("_first"))
        wider = sums.where("_new").select(*keys, "_first", F.struct(*_covered()).alias("now"), F.struct(*_covered("old")).alias("was"))
        changed = wider.where(F.col("_first") | ~F.col("now").eqNullSafe(F.col("was"))).select(*keys, "now.*")
        if rounds > CYCLE_ROUNDS:
            if cyclic is None:
                cyclic = materialize(cyclic_nodes(graph).withColumn("_on", F.lit(True)), "cyclic")
            changed = changed.join(cyclic, "node", "left").select(*keys, *_value({c: F.col(c) for c in VALUE}, F.col("_on").isNull()))
        front = known.append(changed)
    return joined(known.read().where("field is not null"), keys)


def along(graph: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, field, reach) of paths (id, path: an array of tables), for the fields of each last table; unbounded if a hop is missing, and nothing for paths of fewer than two tables."""
    hops = _hops(graph)
    far = many(hops)
    paths = materialize(paths.select("id", "path"), "paths")
    longest = paths.agg(F.max(F.size("path")).alias("n")).first()["n"] or 0
    names = materialize(graph.select(F.col("dst").alias("node"), F.explode("fields.name").alias("field")).distinct(), "names")
    state = shuffled(paths.where(F.size("path") > 1), far).join(hops, (F.get("path", F.lit(0)) == F.col("src")) & (F.get("path", F.lit(1)) == F.col("dst"))).select("id", F.col("dst").alias("node"), "field", *VALUE)
    ended = []
    for at in range(2, longest + 1):
        state = materialize(state, "along")
        over = paths.where(F.size("path") == at).select("id", F.element_at("path", -1).alias("node")).join(shuffled(names, far), "node", "left")
        ended.append(over.join(shuffled(state.withColumn("_on", F.lit(True)), far), ["id", "node", "field"], "left").select("id", "field", *_value({c: F.col(c) for c in VALUE}, F.col("_on"))))
        nexts = paths.select("id", F.get("path", F.lit(at)).alias("next"))
        state = _onward(state, hops, ["id"], far).join(shuffled(nexts, far), "id").where("node = next").select("id", "node", "field", *VALUE)
    out = paths.sparkSession.createDataFrame([], paths.select("id").schema).select("id", F.lit("").alias("field"), *_value(_any())) if not ended else ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out.where("field is not null")
