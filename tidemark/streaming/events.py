"""Arrivals, late data, replays and windowed rollups on streams.

Every transformation takes a streaming or a batch DataFrame and gives the same
rows for the same events.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rollup(events: DataFrame, ts: str, size: str, by: list[str], lateness: str, slide: str | None = None) -> DataFrame:
    """Counts by tumbling (or sliding) window; state is dropped once the watermark has passed a window."""
    e = events.withWatermark(ts, lateness)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], lateness: str) -> DataFrame:
    """Runs of events without a pause of `gap`."""
    g = events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def without_replays(arrivals: DataFrame, ts: str, keys: list[str], lateness: str) -> DataFrame:
    """The first arrival of each key and digest; repeats within the lateness are dropped."""
    e = arrivals.withWatermark(ts, lateness)
    return e.dropDuplicatesWithinWatermark(keys) if e.isStreaming else e.dropDuplicates(keys)


def late(arrivals: DataFrame, bucket_end: str, observed: str, tolerance_seconds: int) -> DataFrame:
    """Arrivals later than the tolerance after their bucket's end."""
    lag = F.unix_timestamp(F.col(observed)) - F.unix_timestamp(F.col(bucket_end))
    return arrivals.withColumn("lag", lag).where(F.col("lag") > tolerance_seconds)


def _sent(last: int | None, times: Iterable[int], window_seconds: int) -> tuple[int | None, list[int]]:
    """What is sent of sorted times after the last one sent."""
    out = []
    for t in times:
        if last is None or t - last >= window_seconds:
            last = t
            out.append(t)
    return last, out


def quiet_alerts(alerts: DataFrame, fingerprint: str, at: str, window_seconds: int) -> DataFrame:
    """(fingerprint, sent): alerts that are sent when repeats within the window of the last one sent are suppressed.

    The window is measured from what was sent, not from what arrived. Alerts are
    sorted by fingerprint and time within partitions and passed once, holding one
    time: no fingerprint is gathered.
    """
    second = F.unix_timestamp(F.col(at).cast("timestamp"))
    rows = alerts.select(F.col(fingerprint).alias("fingerprint"), second.alias("second")).where("second is not null").repartition("fingerprint").sortWithinPartitions("fingerprint", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), None
        for batch in batches:
            kept, times = [], batch.column(1).to_pylist()
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key != now:
                    now, last = key, None
                if last is None or times[i] - last >= window_seconds:
                    last = times[i]
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    kind = rows.schema["fingerprint"].dataType.simpleString()
    return rows.mapInArrow(run, f"fingerprint {kind}, second long").select(F.col("fingerprint").alias(fingerprint), F.col("second").alias("sent"))


def quiet_alert_stream(alerts: DataFrame, fingerprint: str, at: str, window_seconds: int, lateness: str) -> DataFrame:
    """`quiet_alerts` on a stream: each fingerprint's last sent time is its state, dropped once the watermark is a window past it."""
    second = F.unix_timestamp(F.col(at).cast("timestamp"))
    rows = alerts.withWatermark(at, lateness).select(F.col(fingerprint).cast("string").alias("fingerprint"), second.alias("second"), F.col(at).alias("at"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        last, out = _sent(last, sorted(int(t) for frame in frames for t in frame["second"].dropna()), window_seconds)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + window_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"fingerprint": [key[0]] * len(out), "sent": out})

    return rows.groupBy("fingerprint").applyInPandasWithState(step, "fingerprint string, sent long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def _restated(n: Column, versions: Column, unknown: Column) -> Column:
    return (n > 1) & ((versions > 1) | unknown)


def restatements(arrivals: DataFrame, ts: str, key: str, digest: str, keep: str) -> DataFrame:
    """(key, n, versions): keys that arrived more than once, not always with the same digest; one without a digest cannot be told from the others.

    On a stream every arrival of such a key gives its numbers so far, the last of which are those of a batch
    over the same rows. Digests are held with their counts until no arrival of the key has come for
    `keep` (a number of seconds, minutes, hours or days) of event time, so versions are counted exactly however far apart they are within it.
    """
    rows = arrivals.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(digest).cast("string"), F.lit("")).alias("digest"), F.col(ts).cast("timestamp").alias("at"))
    if not arrivals.isStreaming:
        g = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("versions"), F.bool_or(F.col("digest") == "").alias("unknown"))
        return g.where(_restated(F.col("n"), F.col("versions"), F.col("unknown"))).select("key", "n", "versions")
    spark = arrivals.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    number, unit = keep.split()
    held = int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000
    return rows.withWatermark("at", keep).groupBy("key").transformWithStateInPandas(_Versions(held), "key string, n long, versions long", "Update", "EventTime")


class _Versions(StatefulProcessor):
    """Counts of each digest of a key, cleared when its timer runs out."""

    def __init__(self, held_ms: int):
        self.held_ms = held_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.digests = handle.getMapState("digests", "digest string", "n long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        last = self.timer.get()[0] if self.timer.exists() else None
        for frame in rows:
            for digest, n in frame["digest"].value_counts().items():
                had = self.digests.getValue((digest,))[0] if self.digests.containsKey((digest,)) else 0
                self.digests.updateValue((digest,), (had + int(n),))
            newest = int(frame["at"].max().timestamp() * 1000) + self.held_ms
            due = newest if last is None else max(last, newest)
            if due != last:
                if last is not None:
                    self.handle.deleteTimer(last)
                self.handle.registerTimer(due)
                self.timer.update((due,))
                last = due
        found = {d[0]: n[0] for d, n in self.digests.iterator()}
        total = sum(found.values())
        if total > 1 and (len(found) > 1 or "" in found):
            yield pd.DataFrame({"key": [key[0]], "n": [total], "versions": [len(found)]})

    def handleExpiredTimer(self, key: tuple, timer_values: object, expired: object) -> Iterator[pd.DataFrame]:
        self.digests.clear()
        self.timer.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="str"), "n": pd.Series([], dtype="int64"), "versions": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass
