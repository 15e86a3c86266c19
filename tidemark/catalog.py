"""Every registered query with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ship
from tidemark.suites import assets, feeds, governance, graphs, models, observation, partitions, platform

_SUITES = (partitions, graphs, observation, governance, models, assets, platform, feeds)
#: The time zone that the queries' calendar arithmetic is defined in.
ZONE = "UTC"


def _prepared(query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        spark.conf.set("spark.sql.session.timeZone", ZONE)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(f) for s in _SUITES for name, f in s.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for s in _SUITES for name, sql in s.ORACLE_SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["invalidation_plan"](spark, sf_dir)
