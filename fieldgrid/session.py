"""Session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "fieldgrid", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
