"""Results of images as they arrive: a later result replaces an image's earlier one, and counters of jobs and their parents follow.

No state is held between batches. A batch writes the results of its images and what they change of their jobs' counters, both under its
number, and looks at earlier numbers only, so a batch that runs again replaces what it wrote and counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reporting import rollup_shards

RESULT = "job_id long, asset_id long, parent_id long, at timestamp, ok boolean, boxes array<struct<class: string, confidence: double>>"
COUNTS = "parent_id long, job_id long, processed long, failed long, boxes long"


def _read(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    empty = spark.createDataFrame([], f"{schema}, batch long")
    if before == 0:
        return empty
    found = spark.read.schema(f"{schema}, batch long").parquet(path)
    return found if before is None else found.where(F.col("batch") < before)


def _last(rows: DataFrame, *order: str) -> DataFrame:
    """The last row of each image of a job."""
    rest = [c for c in rows.columns if c not in ("job_id", "asset_id")]
    return rows.groupBy("job_id", "asset_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("job_id", "asset_id", "r.*")


def _counted(sign: int, rows: DataFrame) -> DataFrame:
    one = F.lit(sign).cast("long")
    return rows.select("parent_id", "job_id", one.alias("processed"), F.when(~F.coalesce("ok", F.lit(False)), one).otherwise(0).alias("failed"), (sign * F.coalesce("n", F.lit(0)).cast("long")).alias("boxes"))


def fold_batch(batch: DataFrame, number: int, path: str) -> None:
    """Fold a batch of results (RESULT) into the tables under path. Of an image's results in one batch the latest counts; rows without a job or image go."""
    spark = batch.sparkSession
    names = ["job_id", "asset_id", "parent_id", "at", "ok", "boxes"]
    now = _last(batch.select(*names).where("job_id IS NOT NULL AND asset_id IS NOT NULL").withColumn("n", F.size("boxes")), "at", "ok", "n").select(*names)
    now.write.mode("overwrite").parquet(f"{path}/results/batch={number}")
    # Counters need the number of boxes only, so no boxes are shuffled for them.
    told = lambda rows, *more: rows.select("job_id", "asset_id", "parent_id", "ok", F.size("boxes").alias("n"), *more)
    own = told(spark.read.schema(RESULT).parquet(f"{path}/results/batch={number}"))
    earlier = told(_read(spark, f"{path}/results", RESULT, number), "batch").join(own.select("job_id", "asset_id"), ["job_id", "asset_id"], "left_semi")
    change = _counted(1, own).unionByName(_counted(-1, _last(earlier, "batch")))
    sums = change.groupBy("parent_id", "job_id").agg(*(F.sum(c).alias(c) for c in ("processed", "failed", "boxes")))
    sums.write.mode("overwrite").parquet(f"{path}/counters/batch={number}")


def fold_results(results: DataFrame, path: str, progress: str) -> StreamingQuery:
    """Fold a stream of results; reads what there is and ends."""
    return results.writeStream.foreachBatch(lambda batch, number: fold_batch(batch, number, path)).option("checkpointLocation", progress).trigger(availableNow=True).start()


def present_results(spark: SparkSession, path: str) -> DataFrame:
    """The results that stand: of each image of a job those of its last batch."""
    return _last(_read(spark, f"{path}/results", RESULT, None), "batch").drop("batch")


def job_counters(spark: SparkSession, path: str) -> DataFrame:
    """Rows (parent_id, job_id, processed, failed, boxes): sums of what the batches changed."""
    found = _read(spark, f"{path}/counters", COUNTS, None)
    return found.groupBy("parent_id", "job_id").agg(*(F.sum(c).alias(c) for c in ("processed", "failed", "boxes")))


def job_states(counters: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs (job_id, parent_id, total, started_at, ended_at) with processed, failed, boxes and status: RUNNING until all images are processed, FAILED if all of them failed, else COMPLETED."""
    met = jobs.join(counters.drop("parent_id"), "job_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = met.withColumns({c: zero(c) for c in ("processed", "failed", "boxes")})
    status: Column = F.when(F.col("processed") < F.col("total"), "RUNNING").when((F.col("failed") == F.col("total")) & (F.col("total") > 0), "FAILED").otherwise("COMPLETED")
    return rows.withColumn("status", status)


def parent_states(states: DataFrame) -> DataFrame:
    """A row for each parent of job_states (reporting.rollup_shards)."""
    return rollup_shards(states)
