"""Tables written in the folder that driver and executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local master (as in tests) gets a folder of this machine, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fieldgrid.scratch", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldgrid-")
        spark.conf.set("fieldgrid.scratch", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_base(spark)}/fieldgrid/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table: later reads don't compute it again, and its lineage is cut."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(many: DataFrame, one: DataFrame, on: str, rows: str) -> DataFrame:
    """The inner join of many with one, whose keys `on` are unique and which counts in `rows` the rows of many that each has.

    Keys with over a thousandth of all rows (at most a thousand keys) are broadcast, so no task gets all rows of one key. many is read twice.
    """
    limit = max(1000, (one.agg(F.sum(rows)).first()[0] or 0) // 1000)
    hot = one.where(F.col(rows) > limit)
    rest = many.join(F.broadcast(hot.select(on)), on, "left_anti").join(one.where(F.col(rows) <= limit), on)
    return many.join(F.broadcast(hot), on).unionByName(rest)
