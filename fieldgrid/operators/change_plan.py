"""A plan of treatment from changes between surveys: hotspots, their shapes, what layers leave of them, missions and a launch.

Each step is a table of its own; steps that are read more than once are written, so lineage is cut and nothing is computed twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geo import METRES_PLANNING
from ..storage import written
from . import geometry, lists, planning, temporal


@dataclass(frozen=True)
class ChangePlan:
    """The tables of a plan: zones (project_id, sequence, cluster, species, ...), missions (a row for each stop) and flights (a row for each mission, with its launch, start and end)."""

    zones: DataFrame
    missions: DataFrame
    flights: DataFrame


def eligible(scored: DataFrame, kinds: tuple[str, ...], threshold: float) -> DataFrame:
    """Hotspots of changes (with_risk, and project_id) that a plan takes up, with their shapes. A hotspot belongs to the least project of its changes."""
    members = temporal.hotspot_members(scored)
    owner = members.groupBy("cluster").agg(F.min("project_id").alias("project_id"))
    mix = F.to_json(F.struct(F.col("n_new").alias("new"), F.col("n_persistent").alias("persistent")))
    shaped = temporal.hotspots_of(members).join(temporal.hotspot_rings(members), "cluster").join(owner, "cluster").withColumn("mix", mix)
    return lists.eligible_hotspots(shaped, kinds, threshold)


def compliant(zones: DataFrame, layers: DataFrame) -> DataFrame:
    """change_zones cut by layers (geometry.comply), numbered again by falling priority within a project (ties: the zone they come from, then place). Zones of which nothing stays have no row."""
    scale = METRES_PLANNING * F.cos(F.radians("centroid_lat"))
    local = F.transform("ring", lambda p: F.struct(((p.x - F.col("centroid_lon")) * scale).alias("x"), ((p.y - F.col("centroid_lat")) * METRES_PLANNING).alias("y")))
    own = zones.withColumns({"lat0": F.col("centroid_lat"), "lon0": F.col("centroid_lon"), "ring": local})
    cut = geometry.comply(own.withColumn("project_id", F.col("project_id").cast("long")).withColumn("sequence", F.col("sequence").cast("int")), layers.withColumn("project_id", F.col("project_id").cast("long")))
    named = zones.select(F.col("project_id").cast("long").alias("project_id"), F.col("sequence").alias("zone"), "cluster", "species", "dose_per_ha", "dose_source")
    number = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("priority").desc(), "zone", "centroid_lat", "centroid_lon"))
    return cut.join(named, ["project_id", "zone"]).withColumn("sequence", number)


def plan_of_changes(scored: DataFrame, layers: DataFrame, starts: DataFrame, launches: DataFrame, forecast: DataFrame, doses: DataFrame | None = None, kinds: tuple[str, ...] = ("new", "persistent"), threshold: float = 0.3, plan: planning.Plan = planning.Plan()) -> ChangePlan:
    """The plan of changes (temporal.with_risk, and project_id): scored changes become zones that layers allow, missions from the projects' starts, and the launch with the least objective of the forecast.

    layers are as geometry.comply takes them, starts as missions does, launches and forecast as best_launch does, doses (species, dose). Projects without a
    start have zones and no missions; without launches there are no flights.
    """
    zones = written(compliant(planning.change_zones(eligible(scored, kinds, threshold), doses, plan.dose_per_ha), layers), "zones")
    stops = written(planning.missions(zones, starts, plan), "missions")
    flights = stops.groupBy("project_id", "mission").agg(F.first("minutes").alias("minutes"), F.first("area_ha").alias("area_ha"), F.first("litres").alias("litres"), F.count("*").alias("stops"))
    flights = written(flights, "flights")
    best = planning.best_launch(flights, launches, forecast, plan).select("project_id", "launch", "objective")
    timed = planning.schedule(flights.join(best, "project_id"), plan=plan)
    return ChangePlan(zones, stops, timed)
