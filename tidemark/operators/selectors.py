"""A selection language over datasets and their lineage.

Terms separated by spaces are united, terms joined by commas intersect. A term is
a pattern with optional hops: `2+x` adds two levels above, `x+1` one below,
`+x+` everything above and below, and `@x` everything below with all that any
of it needs. A pattern is a shell glob on the name; a bare word matches
anywhere in it; `ns:`, `name:` and `label:` match a part of it or its labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import glob
from tidemark.operators.graph import reach

_TERM = re.compile(r"(?P<at>@)?(?:(?P<up>\d*)(?P<plus>\+))?(?P<pattern>[^+@]+?)(?:(?P<more>\+)(?P<down>\d*))?")


@dataclass(frozen=True)
class Term:
    pattern: str
    field: str = "name"
    up: int | None = 0
    down: int | None = 0
    closed: bool = False

    @classmethod
    def parse(cls, text: str) -> Term:
        m = _TERM.fullmatch(text)
        if not m:
            raise ValueError(f"not a selector: {text!r}")
        hops = lambda sign, n: (int(n) if n else None) if sign else 0
        field, _, rest = m["pattern"].partition(":")
        known = field in ("ns", "name", "label") and rest
        pattern = rest if known else m["pattern"]
        bare = not known and not re.search(r"[*?/]", pattern)
        return cls(f"*{pattern}*" if bare else pattern, field if known else "full", hops(m["plus"], m["up"]), hops(m["more"], m["down"]), bool(m["at"]))


def _matching(term: Term, nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if term.field == "label":
        if labels is None:
            raise ValueError("a label selector needs labels")
        return nodes.join(labels.where(F.col("label").rlike(glob(term.pattern))).select("node"), "node", "left_semi")
    part = {"full": F.col("node"), "ns": F.regexp_replace("node", "/[^/]*$", ""), "name": F.regexp_extract("node", "([^/]*)$", 1)}[term.field]
    return nodes.where(part.rlike(glob(term.pattern)))


def _one(term: Term, edges: DataFrame, nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    found = _matching(term, nodes, labels).select("node")
    parts = [found]
    if term.up != 0:
        parts.append(reach(edges, found, term.up, upstream=True).select("node"))
    if term.down != 0 or term.closed:
        below = reach(edges, found, None if term.closed else term.down).select("node")
        parts.append(below)
        if term.closed:
            parts.append(reach(edges, found.union(below).distinct(), upstream=True).select("node"))
    return reduce(DataFrame.union, parts).distinct()


def select(text: str, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node) that a selection names; labels has node and label."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    sets = [reduce(DataFrame.intersect, [_one(Term.parse(t), edges, nodes, labels) for t in group.split(",")]) for group in text.split()]
    if not sets:
        raise ValueError("an empty selection")
    return reduce(DataFrame.union, sets).distinct()
