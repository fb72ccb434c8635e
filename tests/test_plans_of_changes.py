"""Shapes of hotspots, mission packs, labels of three sources, settings."""

import math

from pyspark.sql import functions as F

from fieldgrid.functions.settings import PlanSettings
from fieldgrid.operators import dataset, temporal
from fieldgrid.sinks import export


def test_hotspot_rings(spark):
    degree = 1 / 111_320
    rows = [(1, -27.0, 153.0), (2, 0.0, 10.0), (2, 0.0, 10.0 + 30 * degree), (2, 40 * degree, 10.0), (3, 0.0, 1.0), (3, 0.0, 1.0 + 10 * degree)]
    got = {r.cluster: r for r in temporal.hotspot_rings(spark.createDataFrame(rows, "cluster long, lat double, lon double")).collect()}
    disc = 16 * math.sin(2 * math.pi / 32) * 81  # a circle of 5 and 4 metres, as a polygon of 32 sides
    assert math.isclose(got[1].area_ha * 10_000, disc, rel_tol=0.01) and math.isclose(got[3].area_ha * 10_000, disc, rel_tol=0.01)
    assert math.isclose(got[2].area_ha * 10_000, 600 + 4 * 120 + math.pi * 16, rel_tol=0.01)
    assert all(r.ring[0] == r.ring[-1] for r in got.values())


def test_mission_pack(spark, tmp_path):
    missions = spark.createDataFrame([(7, 1, 2, 1.23456, 3.0, 10.0, 200.0, 150.0)], "plan_id long, mission int, zones int, area_ha double, litres double, minutes double, distance_before_m double, distance_m double")
    missions = missions.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("decision", "string"), ("score", "double"), ("start", "timestamp"), ("end", "timestamp"), ("mean_wind", "double"), ("max_gust", "double"), ("max_precip", "double"))])
    zones = spark.createDataFrame([(7, 1, 1, "A, b", 3, 0.5, 2.0, 1.0, 1.8, 1.8, -27.0, 153.0, "default-dose"), (7, 2, None, "C", 1, None, 1.0, 0.5, 1.8, 0.9, -27.1, 153.1, None)], "plan_id long, sequence int, mission int, species string, detections int, mean_confidence double, priority double, area_ha double, dose_per_ha double, litres double, centroid_lat double, centroid_lon double, dose_source string")
    stops = spark.createDataFrame([(7, 1, 2, "<B>", -27.1, 153.1), (7, 1, 1, "A", -27.0, 153.0)], "plan_id long, mission int, stop int, species string, lat double, lon double")
    export.write_mission_pack(missions, zones, stops, f"file://{tmp_path}/pack")
    text = lambda name: next((tmp_path / "pack" / name / "plan_id=7").glob("part-*")).read_text().rstrip("\n").split("\n")
    assert text("missions.csv") == [",".join(export.MISSION_HEADER), "1,Mission 1,2,1.2346,3.000,150.0,10.0,200.0,150.0,50.0,25.00,,,,,,,"]
    assert text("zones.csv")[1:] == ['1,1,"A, b",3,0.500,2.000,1.0000,1.800,1.800,-27.0000000,153.0000000,default-dose', "2,,C,1,,1.000,0.5000,1.800,0.900,-27.1000000,153.1000000,"]
    kml = text("missions.kml")[0]
    assert kml.index("<coordinates>153.0,-27.0,0 153.1,-27.1,0</coordinates>") < kml.index("&lt;B&gt;")
    assert text("manifest.json") == ['{"missions":1,"zones":2,"area_ha":1.23456}']


def test_labels_of_three_sources(spark):
    boxes = "x1 double, y1 double, x2 double, y2 double"
    ai = spark.createDataFrame([(1, 5, "Big Weed", 0.9, True, False, False, 0.0, 0.0, 400.0, 300.0)], f"asset_id long, detection_id long, class_name string, confidence double, verified boolean, rejected boolean, user_corrected boolean, {boxes}")
    ring = [(0.0, 0.0), (400.0, 0.0), (400.0, 300.0)]
    manual = spark.createDataFrame([(1, 8, "big weed", ring), (1, 9, "other", ring[:2]), (1, 10, "!", ring)], "asset_id long, annotation_id long, weed_type string, ring array<struct<x: double, y: double>>")
    pending = spark.createDataFrame([(1, 11, "other", 0.9, "ACCEPTED", 0.0, 0.0, 40.0, 30.0), (1, 12, "other", 0.1, "ACCEPTED", 0.0, 0.0, 40.0, 30.0), (1, 13, "other", None, "REJECTED", 0.0, 0.0, 40.0, 30.0)], f"asset_id long, pending_id long, weed_type string, confidence double, status string, {boxes}")
    found = dataset.one_of_equal(dataset.all_boxed_labels(ai, manual, pending, 0.5)).collect()
    assert sorted((r.source, r.id, r["class"]) for r in found) == [("ai", 5, "big_weed"), ("suggestion", 11, "other")]
    assert dataset.all_boxed_labels(ai, manual, pending, 0.5, ("manual",)).count() == 1


def test_plan_settings():
    held = PlanSettings(min_confidence=3, zone_radius_m=1, least_detections=0.5, zones_per_mission=3.9, low_temp=40, high_temp=20, lookahead_hours=100.5, start_lat=-95.0, wind=None).held()
    assert (held.min_confidence, held.zone_radius_m, held.least_detections, held.zones_per_mission, held.lookahead_hours, held.start_lat, held.start_lon, held.wind) == (1, 8, 1, 3, 72, -90, None, 8.0)
    assert held.low_temp == 19 and held.high_temp == 20 and PlanSettings().held() == PlanSettings()
