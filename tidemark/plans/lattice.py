"""How partitions of one table reach partitions of the next.

A Reach says, for one output field, which source values can touch it: the same
value, a window of buckets around the source's time, or anything. Reaches form a
lattice in which widening is always sound: a plan may rebuild too much, never
too little.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from tidemark.functions.time import GRAINS, convert_window

#: Keys that one dirty partition may be spelled out to; beyond it the widest field becomes unconstrained.
MAX_KEYS = 4096


@dataclass(frozen=True)
class Reach:
    """source None: anything; grain None: the same value; else buckets lo..hi of `grain` around times of `fine`."""

    source: str | None = None
    lo: int = 0
    hi: int = 0
    fine: str | None = None
    grain: str | None = None

    def __post_init__(self) -> None:
        if self.grain and (self.fine not in GRAINS or self.grain not in GRAINS or GRAINS.index(self.fine) > GRAINS.index(self.grain)):
            raise ValueError(f"no window from {self.fine} to {self.grain}")
        if self.lo > self.hi:
            raise ValueError("an empty window")

    @property
    def form(self) -> str:
        return "any" if self.source is None else "window" if self.grain else "same"

    def after(self, first: Mapping[str, Reach]) -> Reach:
        """This reach seen through an earlier hop; covers at least walking the two in turn."""
        inner = first.get(self.source, ANYTHING) if self.source else ANYTHING
        if "any" in (self.form, inner.form):
            return ANYTHING
        if self.form == "same":
            return inner
        if inner.form == "same":
            return Reach(inner.source, self.lo, self.hi, self.fine, self.grain)
        if inner.grain != self.fine:
            return ANYTHING
        wide = convert_window(inner.lo, inner.hi, inner.grain, self.grain)
        return Reach(inner.source, wide[0] + self.lo, wide[1] + self.hi, inner.fine, self.grain) if wide else ANYTHING

    def __or__(self, other: Reach) -> Reach:
        """The narrowest reach that covers both."""
        if self == other:
            return self
        alike = self.form == other.form == "window" and (self.source, self.fine, self.grain) == (other.source, other.fine, other.grain)
        return Reach(self.source, min(self.lo, other.lo), max(self.hi, other.hi), self.fine, self.grain) if alike else ANYTHING

    def covers(self, other: Reach) -> bool:
        return self == ANYTHING or (self | other) == self


ANYTHING = Reach()


def same(source: str) -> Reach:
    return Reach(source)


def window(source: str, grain: str, lo: int = 0, hi: int = 0, fine: str | None = None) -> Reach:
    return Reach(source, lo, hi, fine or grain, grain)


def trailing(source: str, n: int, grain: str) -> Reach:
    """A bucket feeds its own output and the n - 1 after it."""
    return window(source, grain, 0, n - 1)


Hop = Mapping[str, Reach]


def compose(first: Hop, second: Hop) -> dict[str, Reach]:
    return {name: reach.after(first) for name, reach in second.items()}


def join(a: Hop, b: Hop) -> dict[str, Reach]:
    """Two ways to reach one table."""
    return {n: a.get(n, ANYTHING) | b.get(n, ANYTHING) for n in sorted({*a, *b})}


def covers(wide: Hop, narrow: Hop) -> bool:
    return all(wide.get(n, ANYTHING).covers(narrow.get(n, ANYTHING)) for n in {*wide, *narrow})
