"""Dense numbers in a given order without gathering the rows: ranges are numbered within, and offset by the counts before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import written


def numbered(df: DataFrame, *order: str | Column, out: str = "n", start: int = 0, ranges: int | None = None) -> DataFrame:
    """df with the long `out`: the row's place in the order, from `start` on, without gaps. Rows that the order doesn't tell apart are numbered as they come.

    Rows are written once in ranges of the order; a task numbers a range, and only the ranges' counts meet in one.
    """
    tagged = df.withColumn("_at", F.monotonically_increasing_id())
    keys = (*order, "_at")
    dealt = tagged.repartitionByRange(ranges, *keys) if ranges else tagged.repartitionByRange(*keys)
    ranged = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    found = ranged.withColumn("_place", place).join(bases, "_range")
    return found.withColumn(out, F.col("_base") + F.col("_place") + (start - 1)).drop("_at", "_range", "_base", "_place")
