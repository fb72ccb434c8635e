"""Operators against small plain-Python restatements and hand-made cases."""

import itertools
import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import box, geo, georef, settings, text, weather
from fieldgrid.operators import dataset, planning, reporting, resolution, spatial, temporal
from fieldgrid.operators.components import components
from fieldgrid.plans import analytics

LAT0, LON0 = -27.0, 153.0


def metres(a, b, radius=6371000.0):
    s = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * radius * math.atan2(math.sqrt(s), math.sqrt(1 - s))


def north(m):
    return LAT0 + m / 111194.9266


def points(rng, n, spread=0.0003):
    return [(i, LAT0 + rng.uniform(0, spread), LON0 + rng.uniform(0, spread)) for i in range(n)]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_golden_projections(spark):
    rows = [("A", -90, 0, 1000, 750, 0, 0), ("B", -90, 0, 1100, 750, 10, 0), ("C", -90, 90, 1100, 750, 0, -10), ("D", -90, 0, 1000, 850, 0, -10), ("E", -90, 180, 1100, 750, -10, 0), ("F", -45, 0, 1000, 750, 0, 100), ("G", -45, 0, 1000, 850, 0, 81.8182), ("H", -45, 270, 1000, 750, -100, 0)]
    df = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "id string, pitch double, yaw double, px double, py double, east double, north double")
    n = lambda v: F.lit(float(v))
    camera = georef.intrinsics(n(1000), n(1000), n(750), n(2000), n(1500), F.lit(None).cast("double"))
    df = df.withColumn("camera", camera).withColumn("o", georef.ground_offset(F.col("px"), F.col("py"), F.col("camera"), F.col("pitch"), n(0), F.col("yaw"), n(100)))
    for r in df.collect():
        assert abs(r.o.east - r.east) < 1e-3 and abs(r.o.north - r.north) < 1e-3, r.id


def test_projection_edges(spark):
    n = lambda v: F.lit(None if v is None else float(v)).cast("double")
    def at(**k):
        row = {"x": 1000.0, "pitch": -90.0, "h": 100.0, "most": None, "tlat": None, "tlon": None, "fov": None, "f": 1000.0, **k}
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
        camera = georef.intrinsics(F.col("f"), n(1000), n(750), n(2000), n(1500), F.col("fov"))
        return georef.project_pixels(df, F.col("x"), n(750), n(-26), n(153), camera, F.col("pitch"), n(0), n(0), F.col("h"), F.col("most"), F.col("tlat"), F.col("tlon")).first().geo

    assert abs(at().lat + 26) < 1e-12 and at(pitch=-1.0) is None and at(h=0.0) is None and at(x=1900.0, most=10.0) is None and at(f=None, fov=180.0) is None and at(f=None, fov=84.0) is not None
    target = at(tlat=-26.5, tlon=153.5)
    assert abs(target.lat + 26.5) < 1e-12 and abs(target.lon - 153.5) < 1e-12
    r = one(spark, h=georef.laser_height(n(100), n(-90), n(0), n(0)), low=georef.laser_height(n(100), n(0), n(0), n(0)))
    assert r.low is None and abs(r.h - 100) < 1e-9
    c = one(spark, a=georef.cascade_height(n(None), n(0), n(55), n(500), n(30), n(100)), b=georef.cascade_height(n(None), n(None), n(None), n(500), n(30), n(100)), c=georef.cascade_height(n(None), n(None), n(None), n(100), n(30), n(100)))
    assert tuple(c.a) == (55.0, "relative_altitude") and tuple(c.b) == (370.0, "absolute_altitude") and tuple(c.c) == (100.0, "default")
    m = F.create_map(F.lit("FOV"), F.lit("84.5"), F.lit("x"), F.lit("no"))
    assert one(spark, a=georef.metadata_number(m, "FieldOfView", "FOV"), b=georef.metadata_number(m, "x")).asDict() == {"a": 84.5, "b": None}


def test_boxes(spark):
    b = lambda *v: box.corner(*map(F.lit, map(float, v)))
    r = one(
        spark, plan=box.tile_plan(F.lit(8192), F.lit(5460)), small=box.should_tile(F.lit(1536), F.lit(1536), F.lit(True)), big=box.should_tile(F.lit(8192), F.lit(5460), F.lit(True)), off=box.should_tile(F.lit(8192), F.lit(5460), F.lit(False)),
        moved=box.from_tile(b(100, 200, 180, 280), F.lit(2048), F.lit(1024), F.lit(8192), F.lit(5460)), clipped=box.from_tile(b(1500, 1500, 1700, 1700), F.lit(6656), F.lit(3924), F.lit(8192), F.lit(5460)),
        label=box.normalised(b(10, 20, 50, 80), F.lit(100), F.lit(100)), iou=box.iou(b(0, 0, 10, 10), b(5, 0, 15, 10)), none=box.iou(b(0, 0, 1, 1), b(1, 1, 2, 2)), smaller=box.overlap_of_smaller(b(0, 0, 10, 10), b(5, 5, 7, 7)),
        a=box.parse_centre(F.lit("[10, 20, 30, 60]")), o=box.parse_centre(F.lit('{"x": 5, "y": 6, "width": 2, "height": 4}')), bad=box.parse_centre(F.lit("[1, 1, 1, 5]")), junk=box.parse_centre(F.lit("junk")),
        poly=box.polygon_box(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(4.0), F.lit(2.0)))), back=box.recentre(b(0, 0, 10, 10), F.lit(98.0), F.lit(50.0), F.lit(100), F.lit(100)),
    )
    t = r.plan
    assert len(t) == 40 and [(t[i].x, t[i].y) for i in (0, 7, 32, 39)] == [(0, 0), (6656, 0), (0, 3924), (6656, 3924)] and [x["index"] for x in t] == list(range(40))
    assert not r.small and r.big and not r.off
    assert tuple(r.moved) == (2148, 1224, 2228, 1304) and tuple(r.clipped) == (8156, 5424, 8192, 5460)
    assert all(math.isclose(x, y) for x, y in zip(r.label, (0.3, 0.5, 0.4, 0.6), strict=True))
    assert math.isclose(r.iou, 1 / 3) and r.none == 0 and r.smaller == 1
    assert tuple(r.a) == (20, 40, 20, 40) and tuple(r.o) == (5, 6, 2, 4) and r.bad is None and r.junk is None and tuple(r.poly) == (2, 1, 4, 2) and tuple(r.back) == (90, 45, 100, 55)


def test_text(spark):
    cases = {"w": "Wattle", " Lantana  Camara ": "Lantana", "lantana-like": "Lantana", "weeping fig": "Weeping Fig", "": "Unknown", None: "Unknown", "SAPLING": "Pine Sapling"}
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: r.t for r in df.select("a", text.detection_type(F.col("a")).alias("t")).collect()} == cases
    lit = lambda v: F.lit(v).cast("string")
    r = one(
        spark, key=text.survey_key(lit("  Morning Flight #2 "), F.lit(None).cast("timestamp")), day=text.survey_key(lit(" "), F.lit("2024-05-06 23:59:00").cast("timestamp")), name=text.survey_name(lit("morning-flight-2")), dated=text.survey_name(lit("date-2024-05-06")), empty=text.slug(lit("--")),
        c1=text.parse_confidence(lit("85")), c2=text.parse_confidence(lit("certain")), c3=text.parse_confidence(lit("x")), c4=text.parse_confidence(lit(None)), csv=text.csv_field(lit('a"b,c')), plain=text.csv_field(lit("a b")), xml=text.xml_text(lit("<a&'\">")), r=text.js_round(F.lit(-2.5)), f=text.to_fixed(F.lit(1.005), 2), h=text.to_fixed(F.lit(0.125), 2), m=text.to_fixed(F.lit(-2.5), 0), z=text.to_fixed(F.lit(0.615), 2), k=text.project_of_key(lit("team/p1/x.jpg")),
    )
    assert (r.key, r.day, r.name, r.dated, r.empty) == ("morning-flight-2", "date-2024-05-06", "Morning Flight 2", "Survey 2024-05-06", "survey")
    assert (r.c1, r.c2, r.c3, r.c4) == (0.85, 0.95, 0.5, 0.5) and (r.csv, r.plain, r.xml) == ('"a""b,c"', "a b", "&lt;a&amp;&apos;&quot;&gt;") and (r.r, r.f, r.h, r.m, r.z, r.k) == (-2, "1.00", "0.13", "-3", "0.61", "p1")


def test_coverage_and_rings(spark):
    n = lambda v: F.lit(None if v is None else float(v)).cast("double")
    square = F.array(*[F.struct(n(x).alias("x"), n(y).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    r = one(spark, none=geo.coverage_radius(n(None), n(84)), zero=geo.coverage_radius(n(0), n(84)), high=geo.coverage_radius(n(500), n(84)), low=geo.coverage_radius(n(2), n(84)), area=geo.ring_area(square), c=geo.ring_centroid(square), inside=geo.point_in_ring(n(1), n(1), square), edge=geo.point_in_ring(n(4), n(2), square), out=geo.point_in_ring(n(5), n(2), square), null=geo.point_in_ring(n(None), n(2), square))
    assert (r.none, r.high, r.low, r.area, tuple(r.c)) == (25.0, 80.0, 12.0, 16.0, (2.0, 2.0)) and math.isclose(r.zero, 30 * math.tan(math.radians(42)))
    assert r.inside and r.edge and not r.out and not r.null


def test_weather(spark):
    w = lambda *v: [F.lit(float(x)) for x in v]
    r = one(spark, calm=weather.severity(*w(2, 3, 5, 20)), windy=weather.severity(*w(8.5, 3, 5, 20)), storm=weather.severity(*w(9, 3, 5, 20)), cold=weather.severity(*w(0, 0, 0, 2)), why=weather.reasons(*w(8.5, 10, 35, 40)))
    assert (r.calm, r.windy, r.storm, r.cold) == (0, 1, 2, 2)
    assert r.why == ["Wind 8.5 m/s exceeds limit 8.0 m/s", "Gusts near limit (10.0 m/s)", "Elevated precipitation risk (35%)", "Temperature 40.0°C is above maximum 35.0°C"]


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    for spread, reach in ((0.0003, 8.0), (0.002, 40.0)):
        a, b = points(rng, 60, spread), points(rng, 70, spread)
        df = lambda p: spark.createDataFrame([*p, (999, None, None)], "id long, lat double, lon double")
        got = {(r.a, r.b) for r in spatial.near_pairs(df(a), df(b), reach).collect()}
        assert got == {(x[0], y[0]) for x in a for y in b if metres(x[1:], y[1:]) <= reach} and got


@pytest.mark.parametrize("lat,lon", [(-27.0, 153.0), (65.0, 20.0), (75.0, -100.0), (-85.0, 10.0), (0.0, 180.0), (70.0, -180.0), (89.9995, 0.0)])
def test_near_pairs_anywhere(spark, lat, lon):
    rng = random.Random(8)

    def some(n, base):
        high = 60 / 111_195
        wide = min(180.0, high / max(1e-6, math.cos(math.radians(lat))))
        out = []
        for i in range(n):
            y, x = lat + rng.uniform(-high, high), lon + rng.uniform(-wide, wide)
            out.append((base + i, min(90.0, y), (x + 180) % 360 - 180))
        return out

    a, b = some(150, 0), some(150, 1000)
    df = lambda p: spark.createDataFrame(p, "id long, lat double, lon double")
    got = [(r.a, r.b) for r in spatial.near_pairs(df(a), df(b), 12.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(x[0], y[0]) for x in a for y in b if metres(x[1:], y[1:]) <= 12.0} and got


def test_large_matchings_go_on_in_rounds(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(a, b, round(rng.random(), 2)) for a in range(30) for b in range(30) if rng.random() < 0.3]
    used, want = set(), set()
    for a, b, c in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            want.add((a, b))
    for walked in (3, 200_000):
        monkeypatch.setattr(spatial, "WALKED", walked)
        got = spatial.match_one_to_one(spark.createDataFrame([*rows, *rows], "a long, b long, cost double")).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert spatial.match_one_to_one(spark.createDataFrame([], "a long, b long, cost double")).count() == 0


def test_clusters_and_components(spark):
    chain = [(i, north(19 * i), LON0) for i in range(40)] + [(100, north(5000), LON0)]
    got = {r.id: r.cluster for r in spatial.clusters(spark.createDataFrame(chain, "id long, lat double, lon double"), 20.0).collect()}
    assert got == {**{i: 0 for i in range(40)}, 100: 100}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    cells = spark.createDataFrame([("s", 0, 0, 1), ("s", 1, 1, 2), ("s", 3, 0, 3), ("t", 2, 2, 4), ("s", 1, 2, 5)], "k string, cx long, cy long, id int")
    by = {}
    for r in spatial.grid_clusters(cells, ("k",)).collect():
        by.setdefault(r.cluster, set()).add(r.id)
    assert sorted(map(sorted, by.values())) == [[1, 2, 5], [3], [4]]


def test_greedy_matching(spark):
    rng = random.Random(2)
    for _ in range(3):
        rows = [(a, b, round(rng.random(), 1)) for a in range(12) for b in range(12) if rng.random() < 0.5]
        used, want = set(), set()
        for a, b, c in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
            if ("a", a) not in used and ("b", b) not in used:
                used |= {("a", a), ("b", b)}
                want.add((a, b))
        got = spatial.match_one_to_one(spark.createDataFrame(rows, "a long, b long, cost double"))
        assert {(r.a, r.b) for r in got.collect()} == want


def test_temporal_changes(spark):
    signal = "id long, species string, confidence double, lat double, lon double"
    base = spark.createDataFrame([(1, "x", 0.9, north(0), LON0), (2, "x", 0.5, north(100), LON0), (3, "x", 0.6, north(200), LON0), (4, "y", 0.6, north(5000), LON0), (5, "x", 0.7, north(300), LON0)], signal)
    comp = spark.createDataFrame([(11, "x", 0.8, north(2.9), LON0), (12, "x", 0.4, north(105), LON0), (13, "y", 0.9, north(200), LON0), (14, "x", 0.7, north(301), LON0), (15, "x", 0.2, north(300.5), LON0)], signal)
    images = spark.createDataFrame([(1, north(150), LON0, 200.0, 120.0), (2, north(60), LON0, None, 84.0)], "asset_id long, gps_lat double, gps_lon double, altitude double, camera_fov double")
    got = temporal.with_risk(temporal.changes(base, comp, images))
    rows = {(r.change_type, r.baseline_id, r.comparison_id): r for r in got.collect()}
    assert set(rows) == {("PERSISTENT", 1, 11), ("PERSISTENT", 5, 15), ("RESOLVED", 2, None), ("RESOLVED", 3, None), ("UNOBSERVED", 4, None), ("NEW", None, 12), ("NEW", None, 13), ("NEW", None, 14)}
    near = rows["PERSISTENT", 5, 15]
    assert math.isclose(near.risk, 0.6 * 0.7 + 0.3 * 1 / 5 + 0.2) and rows["RESOLVED", 2, None].risk == 0
    spots = temporal.hotspots(got).collect()
    assert sorted(r["items"] for r in spots) == [1, 1, 1, 2] and {r.species for r in spots} == {"x", "y"}
    total = temporal.summary(got).agg(F.sum("n_new").alias("n"), F.sum("n_persistent").alias("p"), F.sum("n_unobserved").alias("u")).first()
    assert tuple(total) == (3, 2, 1)
    empty = temporal.changes(base.limit(0), comp.limit(0), images)
    assert empty.count() == 0


def greedy_duplicates(rows, reach, by_class=True, across=True):
    order = sorted(rows, key=lambda r: (-(r["confidence"] or 0), r["created_at"], r["id"]))
    out, groups = {}, []
    for seed in order:
        if seed["id"] in out:
            continue
        group = [seed]
        out[seed["id"]] = seed["id"]
        for c in order:
            if c["id"] in out or (by_class and c["class_name"] != seed["class_name"]) or (across and any(m["asset_id"] == c["asset_id"] for m in group)):
                continue
            if all(metres((m["lat"], m["lon"]), (c["lat"], c["lon"])) <= reach for m in group):
                out[c["id"]] = seed["id"]
                group.append(c)
        groups.append(group)
    return out


def test_duplicates_and_counting(spark):
    rng = random.Random(4)
    rows = [{"id": i, "asset_id": rng.randrange(8), "class_name": rng.choice("ab"), "confidence": rng.choice([None, 0.5, 0.9, rng.random()]), "lat": LAT0 + rng.uniform(0, 0.0001), "lon": LON0 + rng.uniform(0, 0.0001), "created_at": rng.randrange(5)} for i in range(150)]
    df = spark.createDataFrame(pd.DataFrame(rows).astype({"confidence": "float64"}))
    for options in ({}, {"by_class": False}, {"across_images": False}):
        got = {r.id: r.leader for r in resolution.duplicate_groups(df, 1.8, **options).collect()}
        assert got == greedy_duplicates(rows, 1.8, options.get("by_class", True), options.get("across_images", True))
    merged = resolution.representatives(df, resolution.duplicate_groups(df)).collect()
    assert sum(r.members for r in merged) == 150
    clusters = []
    for r in sorted(rows, key=lambda r: (-r["created_at"], r["id"])):
        for c in clusters:
            if metres((r["lat"], r["lon"]), c[:2], 6371008.8) <= 1.0:
                c[0], c[1], c[2] = (c[0] * c[2] + r["lat"]) / (c[2] + 1), (c[1] * c[2] + r["lon"]) / (c[2] + 1), c[2] + 1
                c[3].append(r["id"])
                break
        else:
            clusters.append([r["lat"], r["lon"], 1, [r["id"]]])
    got = {}
    for r in resolution.leader_counts(df, 1.0).collect():
        got.setdefault(r.leader, []).append(r.id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(c[3]) for c in clusters)
    assert resolution.leader_counts(df, 0).where("id <> leader").count() == 0
    biases = resolution.image_bias(df).collect()
    assert biases and all(math.hypot(b.shift_lat * 111111, b.shift_lon * 111111 * math.cos(math.radians(LAT0))) <= 1.6001 for b in biases)


def test_suppression(spark):
    rows = [(1, "i", "c", 0.91, 0, 0, 10, 10), (2, "i", "c", 0.8, 1, 1, 10, 10), (3, "i", "d", 0.72, 1, 1, 10, 10), (4, "i", "c", 0.71, 20, 20, 30, 30), (5, "i", "c", None, 0, 0, 5, 5), (6, "i", "c", 0.6, 5, 5, 5, 9)]
    df = spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows], "id int, image string, class string, confidence double, x1 double, y1 double, x2 double, y2 double")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(resolution.suppress(df, ("image", "class"), 0.45)) == [1, 3, 4]
    assert ids(resolution.suppress(df, ("image",), 0.45)) == [1, 4]
    assert ids(resolution.suppress(df, ("image",), 0.45, budget=1)) == [1]
    assert ids(resolution.suppress(df, ("image",), 0.99, "smaller", inclusive=False)) == [1, 4]
    assert resolution.suppress(df.limit(0), ("image",), 0.45).count() == 0


def test_zones_missions_and_launch(spark):
    rng = random.Random(6)
    rows = [(1, rng.choice(["Lantana", "lantana", "Wattle"]), rng.random(), LAT0 + 0.001 * rng.randrange(6) + rng.uniform(0, 0.0001), LON0 + 0.001 * rng.randrange(6) + rng.uniform(0, 0.0001)) for _ in range(300)]
    df = spark.createDataFrame(rows, "project_id long, species string, confidence double, lat double, lon double")
    plan = planning.Plan(zones=4, area_ha=0.05, litres=2.0)
    found = planning.zones(df, spark.createDataFrame([("LANTANA", 10.0)], "species string, dose double"), plan)
    zones = found.collect()
    assert zones and sum(z.detections for z in zones) <= 300 and sorted(z.sequence for z in zones) == list(range(1, len(zones) + 1))
    assert all(math.isclose(z.litres, z.area_ha * (10.0 if z.species_key == "lantana" else 20.0)) for z in zones)
    starts = spark.createDataFrame([(1, LAT0, LON0)], "project_id long, start_lat double, start_lon double")
    stops = planning.missions(found, starts, plan).collect()
    assert sorted(s.sequence for s in stops) == sorted(z.sequence for z in zones)
    for _, group in itertools.groupby(sorted(stops, key=lambda s: s.mission), key=lambda s: s.mission):
        group = list(group)
        assert len(group) <= 4 and all(s.distance_m <= s.distance_before_m + 1e-6 for s in group)
        assert len(group) == 1 or (group[0].area_ha <= 0.05 and group[0].litres <= 2.0)
    forecast = spark.createDataFrame([(f"2024-01-01 {h:02d}:00:00", 20.0 if h < 6 else 1.0, 2.0, 5.0, 20.0) for h in range(24)], "t string, wind double, gust double, precip double, temp double").withColumn("ts", F.to_timestamp("t")).drop("t")
    flights = spark.createDataFrame([(1, 1, 30.0), (1, 2, 30.0)], "project_id long, mission int, minutes double")
    best = planning.best_launch(flights, forecast.select(F.col("ts").alias("launch")), forecast, plan).first()
    assert best.launch.hour >= 6 and best.no_go == 0


def test_the_first_36_launches_are_tried(spark, monkeypatch):
    hours = [((pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime(), {29: 2.0, 37: 0.0}.get(h, 6.0), 2.0, 5.0, 20.0) for h in range(44)]
    forecast = spark.createDataFrame(hours[::-1], "ts timestamp, wind double, gust double, precip double, temp double").coalesce(1)
    launches = forecast.select(F.col("ts").alias("launch"))
    flights = spark.createDataFrame([(1, 1, 10.0)], "project_id long, mission int, minutes double")
    assert planning.best_launch(flights, launches.union(launches), forecast).first().launch == hours[29][0]
    table = type("Tables", (), {"forecast": forecast})
    monkeypatch.setattr(analytics, "treatment_missions", lambda t: flights)
    assert analytics.launch_times(table).first().launch == hours[29][0]


def test_dataset(spark):
    rows = [(i, 1000 + i % 7, "Class " + "ab"[i % 2], 0.9, True, False, False, 10, 20, 50, 80 + i % 3) for i in range(40)]
    det = spark.createDataFrame(rows, "detection_id long, asset_id long, class_name string, confidence double, verified boolean, rejected boolean, user_corrected boolean, x1 long, y1 long, x2 long, y2 long")
    labels = dataset.boxed_labels(det)
    kept = dataset.one_of_equal(labels)
    assert kept.count() == len({(r[1], r[2], r[10]) for r in rows})
    classes = dataset.class_ids(kept)
    lines = dataset.yolo_lines(kept, classes).collect()
    assert len(lines) == 7 and all(len(x.split()) == 5 for r in lines for x in r.lines.split("\n"))
    sums = {r.asset_id: r.checksum for r in dataset.manifest(kept).collect()}
    assert sums == {r.asset_id: r.checksum for r in dataset.manifest(kept.repartition(3)).collect()}
    assets = spark.range(103).select(F.col("id").alias("asset_id"))
    counts = {r.split: r["count"] for r in dataset.split(assets).groupBy("split").count().collect()}
    assert counts == {"train": 72, "val": 20, "test": 11}
    v = dataset.compare_versions(kept, kept.where("class = 'class_a'")).first()
    assert (v.images_a, v.added, v.removed) == (7, "", "class_b")


@pytest.mark.parametrize("rows", [[], [(1, "A", 5)]])
def test_reporting_edges(spark, rows):
    df = spark.createDataFrame(rows, "id long, status string, n long")
    assert reporting.upsert(df, df, ["id"]).count() == len(rows)
    assert reporting.insert_ignore(df, df, ["id"]).count() == len(rows)
    assert reporting.page(df, [F.col("id")], 1).count() == len(rows)
    assert reporting.latest_of(df, "id", ["n"]).count() == len(rows)


def test_suppression_by_touching_boxes_equals_the_kernel(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.choice([0.5, rng.random()]), x := rng.uniform(0, 40), y := rng.uniform(0, 40), x + rng.uniform(2, 15), y + rng.uniform(2, 15)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, image string, confidence double, x1 double, y1 double, x2 double, y2 double")
    for measure, inclusive in (("iou", True), ("iou", False), ("smaller", True)):
        ids = [sorted(r.id for r in resolution.suppress(df, ("image",), 0.3, measure, inclusive, budget=b).collect()) for b in (None, 1000)]
        assert ids[0] == ids[1] and 0 < len(ids[0]) < 200


def test_suppressed_boxes_of_equal_order_go_by_their_other_columns(spark):
    rows = [(1, 7, name, 0.9, 0.0, 0.0, 10.0, 10.0) for name in "dbeca"]
    schema = "id long, asset_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"
    for given in (rows, rows[::-1], rows[2:] + rows[:2]):
        kept = resolution.suppress(spark.createDataFrame(given, schema).coalesce(1), ("asset_id",), 0.5, "smaller", inclusive=False).collect()
        assert [r.class_name for r in kept] == ["a"]


def test_a_box_text_is_parsed_once(spark):
    parsed = spark.range(1).select(box.parse_centre(F.concat(F.lit("["), F.col("id"), F.lit(",0,2,2]"))).alias("b"))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2  # as an object and as an array
    assert tuple(parsed.first().b) == (1.0, 1.0, 2.0, 2.0)


def test_names_are_cleaned_and_labels_parsed_once(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("s"))
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan(text.detection_type(F.col("s"))).count("regexp_replace") <= 2
    assert plan(settings.centre_of_json(F.col("s"))).count("jsontostructs") + plan(settings.centre_of_json(F.col("s"))).count("from_json") == 1


def test_dense_clusters_keep_no_pairs(spark):
    """Two crowds a little less, and a little more, than the distance apart: cells meet by outermost places or by all; ids that lie in two crowds link them."""
    import numpy as np

    rng = np.random.default_rng(5)
    for lat0, lon0 in ((-27.0, 153.0), (0.0, 179.99999), (84.0, 10.0)):
        step = 1 / (111_195 * np.cos(np.radians(lat0)))
        rows, gap = [], 13.0
        for crowd in range(4):
            for x, y in rng.uniform(0, 1, (150, 2)).tolist():
                rows.append((len(rows), lat0 + (y * 60) / 111_195, float((lon0 + (crowd * (8 + gap) + (crowd >= 2) * 10 + x * 8) * step + 180) % 360 - 180)))
        at = np.array([(a, o) for _, a, o in rows])
        root = list(range(len(rows)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i, (a, o) in enumerate(at.tolist()):
            a0, b0 = np.radians(a), np.radians(at[:, 0])
            s = np.sin((b0 - a0) / 2) ** 2 + np.cos(a0) * np.cos(b0) * np.sin(np.radians(at[:, 1] - o) / 2) ** 2
            for k in np.flatnonzero(2 * 6_371_000 * np.arcsin(np.sqrt(s)) <= 15.0).tolist():
                p, q = find(i), find(k)
                root[max(p, q)] = min(p, q)
        got = {r.id: r.cluster for r in spatial.clusters(spark.createDataFrame(rows, "id long, lat double, lon double"), 15.0).collect()}
        assert got == {i: find(i) for i in range(len(rows))} and len(set(got.values())) >= 2


def test_walks_hold_places_not_pairs():
    """A crowd of 20,000 places within one distance: pairs would take gigabytes."""
    import tracemalloc

    import numpy as np

    from fieldgrid.operators import walks

    rng = np.random.default_rng(1)
    lat, lon = -27 + rng.uniform(0, 1e-6, 20_000), 153 + rng.uniform(0, 1e-6, 20_000)
    tracemalloc.start()
    assert (walks.cliques(lat, lon, None, 1.8, 6_371_000.0) == 0).all() and (walks.running_means(lat, lon, 2.0, 6_371_008.8) == 0).all()
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


def test_counts_and_matches_of_crowds(spark):
    """Strips count what measuring all counts; a heap takes what a walk over all pairs takes; ids may lie in several places."""
    import numpy as np

    from fieldgrid.operators import walks

    rng = np.random.default_rng(3)
    for lat0 in (-27.0, 0.0, 70.0):
        lat, lon = lat0 + rng.uniform(-2e-4, 2e-4, 2000), 153 + rng.uniform(-2e-4, 2e-4, 2000)
        number, own = rng.integers(0, 1700, 2000), rng.uniform(size=2000) < 0.7
        assert (walks.counts(lat, lon, number, own, 15.0, 6_371_000.0) == walks.counts(lat, lon, number, own, 15.0, 6_371_000.0, few=5000)).all()
        a, b = (number[:300] % 250, lat[:300], lon[:300]), (number[300:600] % 250, lat[300:600], lon[300:600])
        every = sorted((float(d), int(i), int(k)) for i, y, x in zip(*a, strict=True) for d, k in zip(walks.metres_between(y, x, b[1], b[2], 6_371_000.0), b[0], strict=True) if d <= 6)
        used, want = set(), []
        for d, i, k in every:
            if (0, i) not in used and (1, k) not in used:
                used |= {(0, i), (1, k)}
                want.append((i, k, d))
        assert walks.nearest_first(a, b, 6.0, 6_371_000.0) == want
    rows = [(int(number[i]), float(lat[i]), float(lon[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    every = {}
    for i, y, x in rows:
        every[i] = every.get(i, 0) + sum(1 for k, v, w in rows if k != i and metres((y, x), (v, w)) <= 9)
    assert {r.id: r.neighbours for r in spatial.neighbour_counts(df, 9.0).collect()} == every
    one = df.dropDuplicates(["id"])
    few = {r.id: r.neighbours for r in spatial.neighbour_counts(one, 9.0).collect()}
    assert {r.id: r.neighbours for r in spatial.least_neighbours(one, 9.0, 5).collect()} == {i: min(5, n) for i, n in few.items()}


def test_box_polygon_code_stays_short_enough_to_compile(spark, capsys):
    n = lambda v: F.lit(float(v)) + F.col("id")
    df = spark.range(3).select("id", *[n(v).alias(k) for k, v in (("x", 10), ("y", 20), ("lat", -27), ("lon", 153), ("pitch", -80), ("yaw", 5), ("up", 50))])
    camera = F.struct(F.lit(2000.0).alias("f"), F.lit(2000.0).alias("cx"), F.lit(1500.0).alias("cy"))
    own = [F.col(c) for c in ("x", "y")]
    found = georef.box_polygon(df, *own, F.lit(40.0), F.lit(30.0), F.col("lat"), F.col("lon"), camera, F.col("pitch"), F.lit(0.0), F.col("yaw"), F.col("up"))
    assert all(len(r.polygon) == 5 and r.polygon[0] == r.polygon[4] for r in found.collect())
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found.select("id", "polygon").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # HotSpot interprets longer methods
