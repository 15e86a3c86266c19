"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, divergence, html_extract, langid, packing, pii, ppm, prefix_trie, resampling, simhash, tokencount, toxicity, warc
from tidemark.session import ship

_MODULES = (divergence, pii, toxicity, ppm, html_extract, warc, simhash, packing, decontamination, langid, tokencount, resampling, prefix_trie)


def _shipped(query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
