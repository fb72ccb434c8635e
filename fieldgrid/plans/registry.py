"""Where queries are registered with the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bridge import Bridge, with_bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a Bridge under its name; sql names bridge tables in braces. Without sql, tests hold it against brute force."""

    def register(f: Callable[[Bridge], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_bridge(sql)
        return f

    return register
