"""Calendar grains: truncation, stepping and windows of buckets. All times are naive UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From fine to coarse.
GRAINS = ("hour", "day", "month", "year")
#: How many fine buckets the smallest coarse one spans, for widening shifted windows.
LEAST_SPAN = {("hour", "day"): 23, ("hour", "month"): 671, ("day", "month"): 28, ("hour", "year"): 8759, ("day", "year"): 365, ("month", "year"): 12}
MAX_BUCKETS = 100_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncate(ts: Column | str, grain: str) -> Column:
    """Start of the bucket that holds `ts`."""
    return F.date_trunc(grain, _c(ts)).cast("timestamp_ntz")


def step(ts: Column | str, n: Column | int, grain: str) -> Column:
    """`ts` moved by n grains; months and years clamp the day."""
    n = F.lit(n) if isinstance(n, int) else n
    part = {"year": {"years": n}, "month": {"months": n}, "day": {"days": n}, "hour": {"hours": n}}[grain]
    return (_c(ts) + F.make_interval(**part)).cast("timestamp_ntz")


def span(first: Column | str, last: Column | str, grain: str) -> Column:
    """Every bucket from `first` to `last`, both included; none if they are the wrong way round."""
    a, b = _c(first), _c(last)
    return F.when(a <= b, F.sequence(a, b, F.expr(f"interval 1 {grain}"))).otherwise(F.array().cast("array<timestamp_ntz>"))


def reached(ts: Column | str, lo: int, hi: int, grain: str) -> Column:
    """Buckets from lo to hi grains around the one that holds `ts`."""
    if hi - lo >= MAX_BUCKETS:
        raise ValueError(f"a window of {hi - lo + 1} buckets is over {MAX_BUCKETS}")
    at = truncate(ts, grain)
    return span(step(at, lo, grain), step(at, hi, grain), grain)


def convert_window(lo: int, hi: int, fine: str, coarse: str) -> tuple[int, int] | None:
    """The window in coarse grains that is sure to cover one in fine grains; None if it would refine."""
    if fine == coarse:
        return lo, hi
    least = LEAST_SPAN.get((fine, coarse))
    if least is None:
        return None
    up = lambda n: -(-n // least)
    return (0 if lo >= 0 else -(up(-lo) + 1)), (0 if hi <= 0 else up(hi) + 1) + 1


def widened_window(lo: Column | str, hi: Column | str, fine: str, coarse: str) -> Column:
    """`convert_window` for windows in columns: a struct of lo and hi, null if it would refine."""
    lo, hi, least = _c(lo).cast("long"), _c(hi).cast("long"), LEAST_SPAN.get((fine, coarse))
    pair = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    if fine == coarse:
        return pair(lo, hi)
    if least is None:
        return F.lit(None).cast("struct<lo:bigint,hi:bigint>")
    up = lambda n: F.ceil(n / least)
    return pair(F.when(lo >= 0, 0).otherwise(-(up(-lo) + 1)), F.when(hi <= 0, 0).otherwise(up(hi) + 1) + 1)


def cycle_bucket(ts: Column | str, cycle: str) -> Column:
    """Position in a cycle: hour of day, weekday (Monday 0), day of month, month of year."""
    return {"hour_of_day": F.hour, "weekday": F.weekday, "day_of_month": F.dayofmonth, "month_of_year": F.month}[cycle](_c(ts))


def arrival_lag(bucket: Column | str, observed: Column | str, grain: str) -> Column:
    """Seconds from the end of a bucket to its arrival."""
    return F.unix_timestamp(_c(observed).cast("timestamp")) - F.unix_timestamp(step(bucket, 1, grain).cast("timestamp"))
