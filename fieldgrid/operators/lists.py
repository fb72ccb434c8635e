"""Filtered lists, summaries and checks that pages and reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.settings import change_mix


def change_list(found: DataFrame, change_type: str | None = None, species: str | None = None, least_risk: float = 0.0) -> DataFrame:
    """changes of a type, a species and a risk from `least_risk` on (0: any), as far as each is given; an unknown type counts as none given."""
    if change_type in ("NEW", "PERSISTENT", "RESOLVED", "UNOBSERVED"):
        found = found.where(F.col("change_type") == change_type)
    if species:
        found = found.where(F.col("species") == species)
    return found.where(F.col("risk") >= least_risk) if least_risk > 0 else found


def hotspot_list(found: DataFrame, species: str | None = None, least_priority: float = 0.0) -> DataFrame:
    if species:
        found = found.where(F.col("species") == species)
    return found.where(F.col("priority") >= least_priority) if least_priority > 0 else found


def eligible_hotspots(found: DataFrame, kinds: tuple[str, ...] = ("new", "persistent"), threshold: float = 0.0) -> DataFrame:
    """hotspots (mix: JSON of counts by change, mean_risk, priority, ring) that a plan of changes takes up: some change of the kinds, a risk (mean risk, else priority, else 0) from the threshold on, and a ring. With `risk` and `included`."""
    mix = change_mix(F.col("mix"))
    included = sum((F.coalesce(F.element_at(mix, k), F.lit(0.0)) for k in kinds), F.lit(0.0))
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    rated = found.withColumns({"included": included, "risk": F.coalesce(number("mean_risk"), number("priority"), F.lit(0.0))})
    return rated.where((F.col("included") > 0) & (F.col("risk") >= threshold) & (F.coalesce(F.size("ring"), F.lit(0)) > 0))


def concept_candidates(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """candidates with `score` (similarity, else confidence, else 0) from the threshold on, and their place within an image by falling score."""
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    rated = found.withColumn("score", F.coalesce(number("similarity"), number("confidence"), F.lit(0.0))).where(F.col("score") >= threshold)
    return rated.withColumn("place", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.col("score").desc(), "id")))


def with_floor(found: DataFrame, strict: float, relaxed: float, floor: int, most: int) -> DataFrame:
    """concept_candidates of each image by the strict threshold; images with fewer than `floor` of them take the relaxed one; at most `most` a image, with `used_relaxed`."""
    rated = concept_candidates(found, relaxed)
    passed = F.count_if(F.col("score") >= strict).over(Window.partitionBy("asset_id"))
    chosen = rated.withColumn("used_relaxed", passed < floor)
    return chosen.where(F.col("used_relaxed") | (F.col("score") >= strict)).where(F.col("place") <= most)


def best_crops(found: DataFrame, least: float, most: int) -> DataFrame:
    """Of each class the first crops by falling confidence, from the least on."""
    place = F.row_number().over(Window.partitionBy("class_name").orderBy(F.col("confidence").desc(), "id"))
    return found.where(F.col("confidence") >= least).withColumn("place", place).where(F.col("place") <= most)


def capped(groups: DataFrame, order: list[Column], most: int = 500) -> DataFrame:
    """The first groups of an order, each with `truncated`: whether there are more."""
    first = groups.orderBy(*order).limit(most + 1)
    whole = first.agg((F.count("*") > most).alias("truncated"))
    return first.orderBy(*order).limit(most).crossJoin(F.broadcast(whole))  # whole is one row


def ordered_scope(stored: DataFrame, pending: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows (session_id, asset_id, place): a session's stored assets (session_id, asset_id, position) that are pending, in their stored order, then the other pending ones by id."""
    both = pending.select(key, "asset_id").distinct().join(stored.groupBy(key, "asset_id").agg(F.min("position").alias("position")), [key, "asset_id"], "left")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("position").asc_nulls_last(), "asset_id"))
    return both.select(key, "asset_id", place.alias("place"))


def execution_summary(log: DataFrame, key: str = "job_id") -> DataFrame:
    """A row for each job of its asset entries (job_id, stage, asset_id, status, mode, warning, expanded, profile, at): modes and warnings that occur, assets by what happened to them, the last profile, and whether anything ran."""
    rows = log.where("stage = 'run' AND asset_id IS NOT NULL")
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    expanded = F.coalesce("expanded", F.lit(False))
    unrefined = F.coalesce(F.col("mode").contains("candidates_unrefined"), F.lit(False))
    assets = lambda when: F.countDistinct(F.when(when, F.col("asset_id")))
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(some(c), F.col(c)))), ",")
    return rows.groupBy(key).agg(
        texts("mode").alias("modes"), texts("warning").alias("warnings"), assets(expanded).alias("expanded_assets"), assets(unrefined).alias("unrefined_assets"), assets(expanded | unrefined | some("warning")).alias("degraded_assets"),
        F.max_by("profile", F.when(some("profile"), F.col("at"))).alias("profile"), F.bool_or(F.coalesce(F.col("status").isin("completed", "failed"), F.lit(False))).alias("confirmed"),
    )


def tiling_totals(runs: DataFrame, key: str = "project_id") -> DataFrame:
    """Images that were tiled, their tiles, and detections before and after merging, of rows (project_id, asset_id, tiles, raw, merged)."""
    return runs.groupBy(key).agg(F.count_if(F.col("tiles") > 1).alias("tiled_images"), F.sum(F.when(F.col("tiles") > 1, F.col("tiles")).otherwise(0)).alias("tiles"), F.sum("raw").alias("raw"), F.sum("merged").alias("merged"))


def map_view(places: DataFrame, key: str) -> DataFrame:
    """The middle (mean of places) and the bounds of each map."""
    return places.groupBy(key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])


def strategy_totals(results: DataFrame, key: str = "strategy") -> DataFrame:
    """Detections, and assets by outcome, of each strategy's results (strategy, asset_id, count, outcome)."""
    n = lambda s: F.count_if(F.col("outcome") == s)
    return results.groupBy(key).agg(F.sum("count").alias("detections"), n("success").alias("success_assets"), n("zero_detections").alias("zero_assets"), n("error").alias("error_assets"))


def complete_responses(prompts: DataFrame, answers: DataFrame, key: str = "request_id") -> DataFrame:
    """Whether each request (request_id, id) has exactly one answer (request_id, id) for each id that it asked for; other answers don't matter."""
    counts = answers.groupBy(key, "id").agg(F.count("*").alias("n"))
    return prompts.select(key, "id").distinct().join(counts, [key, "id"], "left").groupBy(key).agg(F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False))).alias("complete"))


def nested_plans(plans: DataFrame, missions: DataFrame, zones: DataFrame) -> DataFrame:
    """A row for each plan with its missions in order, each with its zones in order: plans (plan_id, ...), missions (plan_id, mission, ...), zones (plan_id, mission, sequence, ...)."""
    inner = zones.groupBy("plan_id", "mission").agg(F.array_sort(F.collect_list(F.struct("sequence", *[c for c in zones.columns if c not in ("plan_id", "mission", "sequence")]))).alias("zones"))
    own = missions.join(inner, ["plan_id", "mission"], "left").withColumn("zones", F.coalesce("zones", F.array()))
    rest = [c for c in missions.columns if c not in ("plan_id", "mission")]
    outer = own.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("mission", *rest, "zones"))).alias("missions"))
    return plans.join(outer, "plan_id", "left").withColumn("missions", F.coalesce("missions", F.array()))


def compliance_counts(zones: DataFrame, parts: DataFrame) -> DataFrame:
    """A row for each project: zones (project_id, sequence, area_ha), those of which nothing is left in parts (project_id, zone, area_ha), those that came apart, and hectares taken out."""
    kept = parts.groupBy("project_id", F.col("zone").alias("sequence")).agg(F.count("*").alias("n"), F.sum("area_ha").alias("left_ha"))
    both = zones.select("project_id", "sequence", "area_ha").join(kept, ["project_id", "sequence"], "left")
    return both.groupBy("project_id").agg(F.count("*").alias("zones"), F.count_if(F.col("n").isNull()).alias("excluded"), F.count_if(F.col("n") > 1).alias("split"), F.sum(F.col("area_ha") - F.coalesce("left_ha", F.lit(0.0))).alias("excluded_ha"))


def plan_totals(stops: DataFrame, key: str = "project_id") -> DataFrame:
    """Missions, hectares, litres, minutes and metres of each plan, and what the better routes save, of mission stops (project_id, mission, area_ha, litres, minutes, distance_before_m, distance_m)."""
    one = stops.groupBy(key, "mission").agg(*[F.first(c).alias(c) for c in ("area_ha", "litres", "minutes", "distance_before_m", "distance_m")], F.count("*").alias("stops"))
    return one.groupBy(key).agg(F.count("*").alias("missions"), *[F.sum(c).alias(c) for c in ("stops", "area_ha", "litres", "minutes", "distance_m")], F.sum(F.col("distance_before_m") - F.col("distance_m")).alias("saved_m"))
