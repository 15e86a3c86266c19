"""Soundness of the lattice: composing and joining never reach less than walking."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.time import GRAINS
from tidemark.plans.lattice import ANYTHING, Reach, compose, covers, join, same, trailing, window


def start(t, grain):
    cut = {"hour": (t.year, t.month, t.day, t.hour), "day": (t.year, t.month, t.day), "month": (t.year, t.month, 1), "year": (t.year, 1, 1)}[grain]
    return datetime(*cut)


def moved(t, n, grain):
    if grain in ("hour", "day"):
        return t + timedelta(**{grain + "s": n})
    months = t.year * 12 + t.month - 1 + n * (12 if grain == "year" else 1)
    return datetime(months // 12, months % 12 + 1, 1)


def reached(r: Reach, t):
    at = start(t, r.grain)
    return {moved(at, n, r.grain) for n in range(r.lo, r.hi + 1)}


@st.composite
def windows(draw, fine=None):
    i = draw(st.integers(0, 3)) if fine is None else GRAINS.index(fine)
    j = draw(st.integers(i, 3))
    lo = draw(st.integers(-2, 2))
    return Reach("dt", lo, draw(st.integers(lo, lo + 4)), GRAINS[i], GRAINS[j])


@st.composite
def chains(draw):
    a = draw(windows())
    return a, draw(windows(fine=a.grain))


times = st.datetimes(datetime(2000, 1, 1), datetime(2040, 12, 31))


@given(chains(), times)
@settings(max_examples=500, deadline=None)
def test_compose_covers_walking(chain, t):
    a, b = chain
    walked = set().union(*(reached(b, x) for x in reached(a, t)))
    whole = compose({"dt": a}, {"dt": b})["dt"]
    assert whole == ANYTHING or walked <= reached(whole, t)


@given(windows(), windows(), windows())
@settings(max_examples=300, deadline=None)
def test_join_is_a_bound(a, b, c):
    j = a | b
    assert j.covers(a) and j.covers(b)
    assert (a | b) == (b | a) and (a | a) == a
    assert ((a | b) | c).covers(a | (b | c)) and (a | (b | c)).covers((a | b) | c)


def test_forms():
    assert compose({"p": same("q")}, {"x": same("p")}) == {"x": same("q")}
    assert compose({}, {"x": same("p")}) == {"x": ANYTHING}
    day, week = {"dt": window("dt", "day")}, {"dt": trailing("dt", 7, "day")}
    assert join(day, week) == week
    assert covers(week, day) and not covers(day, week)
    assert compose(day, {"dt": window("dt", "month", fine="day")})["dt"] == Reach("dt", 0, 1, "day", "month")
    assert (same("a") | same("b")) == ANYTHING
    with pytest.raises(ValueError):
        Reach("dt", 0, 0, "month", "day")
    with pytest.raises(ValueError):
        Reach("dt", 1, 0, "day", "day")
