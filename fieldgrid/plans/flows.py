"""Chains of operators over whole tables: a plan of changes from surveys to flights, results of images folded batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import change_plan
from ..sources.bridge import Bridge
from ..storage import scratch, written
from ..streaming import results
from .analytics import temporal_changes
from .registry import query


def _plan(t: Bridge) -> change_plan.ChangePlan:
    projects = t.detection.select(F.col("detection_id").alias("comparison_id"), "project_id").groupBy("comparison_id").agg(F.min("project_id").alias("project_id"))
    scored = temporal_changes(t).join(projects, "comparison_id")
    ring = lambda d: F.array(*[F.struct((F.col("center_lon") + x * d).alias("x"), (F.col("center_lat") + y * d).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    layers = t.project.select("project_id", F.lit("allowed").alias("kind"), F.lit(0.0).alias("buffer_m"), ring(0.0038).alias("ring")).unionByName(t.project.select("project_id", F.lit("exclusion").alias("kind"), F.lit(10.0).alias("buffer_m"), ring(0.001).alias("ring")))
    starts = t.project.select("project_id", F.col("center_lat").alias("start_lat"), F.col("center_lon").alias("start_lon"))
    doses = t.part.select(F.col("p_type").alias("species")).distinct().where("species = 'ECONOMY'").withColumn("dose", F.lit(12.5))
    return change_plan.plan_of_changes(scored, layers, starts, t.forecast.select(F.col("ts").alias("launch")), t.forecast, doses)


@query()
def plan_of_changes(t: Bridge) -> DataFrame:
    """The stops of the plan of all projects' changes with their flights."""
    plan = _plan(t)
    flights = plan.flights.select("project_id", "mission", "launch", "start", "end", "objective")
    stops = plan.missions.join(flights, ["project_id", "mission"])
    return stops.join(plan.zones.select("project_id", "sequence", "zone", "cluster", "species", F.col("area_ha").alias("zone_ha"), F.col("litres").alias("zone_litres")), ["project_id", "sequence"])


def _streamed(t: Bridge) -> str:
    """Results of all images in two runs, the first with strong detections alone, as a stream of two batches a run, which are each folded twice; a batch has a file for every other core."""
    arrivals, path = scratch(t.spark, "results"), scratch(t.spark, "folded")
    box = F.struct(F.col("class_name").alias("class"), "confidence")
    found = t.detection.groupBy("asset_id").agg(F.collect_list(box).alias("boxes"))
    images = t.asset.select("asset_id", (F.col("project_id") * 2 + F.col("asset_id") % 2).cast("long").alias("job_id"), F.col("project_id").cast("long").alias("parent_id")).join(found, "asset_id", "left")
    images, many = written(images, "images"), max(1, t.spark.sparkContext.defaultParallelism // 2)
    for run, kept in enumerate((lambda b: b.confidence >= 0.9, lambda b: F.lit(True))):
        rows = images.where("asset_id % 3 <> 1") if run else images
        rows.select("job_id", "asset_id", "parent_id", F.timestamp_seconds(F.lit(run)).alias("at"), (F.col("asset_id") % 10 != 7).alias("ok"), F.filter("boxes", kept).alias("boxes")).repartition(2 * many).write.mode("append").parquet(arrivals)

    def twice(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            results.fold_batch(batch, number, path)

    stream = t.spark.readStream.schema(results.RESULT).option("maxFilesPerTrigger", many).parquet(arrivals)
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", scratch(t.spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return path


@query("""WITH b AS (SELECT asset_id, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.9) AS strong FROM {detection} GROUP BY asset_id)
  SELECT project_id::BIGINT AS parent_id, (project_id * 2 + a.asset_id % 2)::BIGINT AS job_id, count(*) AS processed, count(*) FILTER (WHERE a.asset_id % 10 = 7) AS failed, sum(coalesce(CASE WHEN a.asset_id % 3 <> 1 THEN n ELSE strong END, 0))::BIGINT AS boxes FROM {asset} a LEFT JOIN b ON a.asset_id = b.asset_id GROUP BY 1, 2""")
def streamed_results(t: Bridge) -> DataFrame:
    return results.job_counters(t.spark, _streamed(t))


@query("""SELECT project_id::BIGINT AS parent_id, count(DISTINCT asset_id % 2) AS shards, count(*) AS processed, count(*) AS total, 'COMPLETED' AS status FROM {asset} GROUP BY project_id""")
def streamed_parents(t: Bridge) -> DataFrame:
    """States of the parents once all images have results."""
    jobs = t.asset.groupBy((F.col("project_id") * 2 + F.col("asset_id") % 2).cast("long").alias("job_id")).agg(F.min("project_id").cast("long").alias("parent_id"), F.count("*").alias("total"), F.min("flight_date").cast("timestamp").alias("started_at"), F.max("flight_date").cast("timestamp").alias("ended_at"))
    states = results.job_states(results.job_counters(t.spark, _streamed(t)), jobs)
    return results.parent_states(states).select("parent_id", "shards", "processed", "total", "status")
