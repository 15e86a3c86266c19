"""Profiles from Parquet footers: no row is read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = "path string, name string, row_count long, null_count long, min string, max string, bytes long"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for uri in batch.column(0).to_pylist():
            fs, path = pafs.FileSystem.from_uri(uri)
            meta = pq.read_metadata(path, filesystem=fs)
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    col = group.column(c)
                    s = col.statistics
                    bounded = s is not None and s.has_min_max
                    rows.append((uri, col.path_in_schema, group.num_rows, s.null_count if s is not None and s.has_null_count else None, str(s.min) if bounded else None, str(s.max) if bounded else None, col.total_compressed_size))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "name", "row_count", "null_count", "min", "max", "bytes"]) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=["path", "name", "row_count", "null_count", "min", "max", "bytes"])


def footer_profile(files: DataFrame, path: str = "path") -> DataFrame:
    """(name, row_count, null_count, bytes) over the footers of many files; unknown null counts stay unknown."""
    stats = files.select(path).mapInArrow(_stats, _FIELDS)
    unknown = F.max(F.col("null_count").isNull().cast("int")) == 1
    return stats.groupBy("name").agg(F.sum("row_count").alias("row_count"), F.when(~unknown, F.sum("null_count")).alias("null_count"), F.sum("bytes").alias("bytes"))
