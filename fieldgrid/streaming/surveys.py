"""Our extension: surveys kept up to date as images arrive, and duplicate jobs dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import survey_key
from ..sinks.tables import replace_by_key  # noqa: F401 (for foreachBatch: a repeated batch changes nothing)


def running_surveys(assets: DataFrame, late: str = "1 day", span: str = "30 days") -> DataFrame:
    """Counts and ranges of each survey of a stream (project_id, flight_session, flight_date) by spans of time, in update mode; rows later than `late` behind may be left out, and spans that ended before that leave the state. A survey over several spans has a row for each."""
    keyed = assets.withWatermark("flight_date", late).withColumn("survey_key", survey_key(F.col("flight_session"), F.col("flight_date")))
    return keyed.groupBy("project_id", "survey_key", F.window("flight_date", span).alias("span")).agg(F.count("*").alias("assets"), F.min("flight_date").alias("first_at"), F.max("flight_date").alias("last_at"))


def fold_surveys(assets: DataFrame, path: str, progress: str) -> StreamingQuery:
    """Counts and ranges of each survey in each batch, written under the batch's number: no state is held, and a repeated batch replaces its own rows. Reads what there is and ends."""

    def fold(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("survey_key", survey_key(F.col("flight_session"), F.col("flight_date")))
        keyed.groupBy("project_id", "survey_key").agg(F.count("*").alias("assets"), F.min("flight_date").alias("first_at"), F.max("flight_date").alias("last_at")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return assets.writeStream.foreachBatch(fold).option("checkpointLocation", progress).trigger(availableNow=True).start()


def surveys_so_far(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """One row for each survey of the folded batches, whose projects have ids of a kind."""
    parts = spark.read.schema(f"project_id {kind}, survey_key string, assets long, first_at timestamp, last_at timestamp, batch long").parquet(path)
    return parts.groupBy("project_id", "survey_key").agg(F.sum("assets").alias("assets"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def new_jobs(jobs: DataFrame, key: str = "job_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """A stream of jobs without those whose key came before, within `late`."""
    return jobs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
