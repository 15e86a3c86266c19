"""Counters, gauges and histograms that are taken in the pass that writes, not in a second scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_ROW = "name string, kind string, bucket double, value double"


class Measures:
    """What to take of rows: sums, greatest values, and counts of values up to each bound."""

    def __init__(self, counters: Mapping[str, Column] | None = None, gauges: Mapping[str, Column] | None = None, histograms: Mapping[str, tuple[Column, Sequence[float]]] | None = None):
        self.counters, self.gauges, self.histograms = dict(counters or {}), dict(gauges or {}), dict(histograms or {})

    def columns(self) -> list[Column]:
        """Aggregates, named so that `rows` can tell them apart."""
        out = [F.sum(c).cast("double").alias(f"counter|{n}|") for n, c in self.counters.items()]
        out += [F.max(c).cast("double").alias(f"gauge|{n}|") for n, c in self.gauges.items()]
        for n, (c, bounds) in self.histograms.items():
            out += [F.sum(F.when(c <= b, 1).otherwise(0)).cast("double").alias(f"histogram|{n}|{float(b)!r}") for b in sorted(bounds)]
            out += [F.count(c).cast("double").alias(f"histogram|{n}|inf"), F.sum(c).cast("double").alias(f"sum|{n}|")]
        return out


def rows(taken: Mapping[str, float | None]) -> list[tuple[str, str, float | None, float | None]]:
    """(name, kind, bucket, value) of what was taken; a histogram's buckets are cumulative, the last one is all values."""
    parts = [(*name.split("|"), value) for name, value in taken.items() if name.count("|") == 2]
    return [(n, kind, float(bound) if bound else None, None if value is None else float(value)) for kind, n, bound, value in parts]


def write(df: DataFrame, path: str, measures: Measures, by: Sequence[str] = (), mode: str = "overwrite", name: str = "measures") -> DataFrame:
    """Write rows as Parquet and return what was measured of them on the way: (name, kind, bucket, value).

    Rows that a task wrote again after a failure are counted once.
    """
    seen = Observation(name)
    observed = df.observe(seen, *measures.columns())
    observed.write.mode(mode).partitionBy(*by).parquet(path)
    return df.sparkSession.createDataFrame(rows(seen.get), _ROW)


class StreamMeasures(StreamingQueryListener):
    """Adds up what streams observe under a name: counters and histograms are summed over batches, gauges keep the greatest."""

    def __init__(self, name: str = "measures"):
        self.name, self.taken, self.batches = name, {}, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = p.observedMetrics.get(self.name)
        if found is None or (p.id, p.batchId) in self.batches:
            return
        self.batches.add((p.id, p.batchId))
        for k, v in found.asDict().items():
            if v is not None:
                had = self.taken.get(k)
                self.taken[k] = v if had is None else max(had, v) if k.startswith("gauge|") else had + v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(rows(self.taken), _ROW)
