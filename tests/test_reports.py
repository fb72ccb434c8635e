"""Reports, settings and merges: small cases, and whole queries against plain restatements."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldgrid.functions import geo, settings, text
from fieldgrid.operators import evaluation, feeds, resolution, temporal
from fieldgrid.plans import reports
from fieldgrid.sources import readers
from fieldgrid.sources.bridge import Bridge

from .test_whole_queries import greedy, pairs


def metres(a, b):
    s = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_008.8 * math.atan2(math.sqrt(s), math.sqrt(1 - s))


def plain_objects(rows, reach):
    """Seeds by confidence, time and id; each takes what is near all its members, from images that it hasn't."""
    rows = sorted(rows, key=lambda r: (-(r[2] or 0.0), r[5], r[0]))
    left, out = dict.fromkeys(range(len(rows))), {}
    for i in range(len(rows)):
        if i not in left:
            continue
        group = [i]
        for j in left:
            if j != i and all(rows[m][1] != rows[j][1] and metres(rows[m][3:5], rows[j][3:5]) <= reach for m in group):
                group.append(j)
        for m in group:
            del left[m]
        weights = [max(rows[m][2] or 0.0, 1e-6) for m in group]
        place = tuple(sum(w * rows[m][c] for w, m in zip(weights, group)) / sum(weights) for c in (3, 4))
        out[rows[i][0]] = (len(group), *place, sum(weights) / len(group) if len(group) > 1 else rows[i][2])
    return out


def test_calibration_points(spark):
    t = Bridge(spark, "/root/testdata/sf0.001")
    good = t.detection.where("NOT rejected AND (verified OR user_corrected)").select(F.col("detection_id").alias("id"), "asset_id", "confidence", "lat", "lon", "created_at")
    one = {r[0]: tuple(r) for r in sorted(good.collect(), key=lambda r: tuple((v is not None, v) for v in r[1:]), reverse=True)}
    near = [(i, a, c, lat // 0.01 * 0.01 + lat % 0.0004, lon // 0.01 * 0.01 + lon % 0.0004, at) for i, a, c, lat, lon, at in one.values()]  # drawn closer, so that groups arise
    drawn = spark.createDataFrame(near, good.schema)
    got = {r.id: (r.members, r.lat, r.lon, r.confidence) for r in resolution.calibration_points(drawn).collect()}
    want = plain_objects(near, 1.8)
    assert got.keys() == want.keys() and sum(v[0] > 1 for v in want.values()) > 20
    for k, v in want.items():
        assert got[k][0] == v[0] and all(a == b or math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[k][1:], v[1:]))
    assert sum(r.members for r in reports.calibrated_objects(t).collect()) == good.select("id").distinct().count()


def test_plan_totals_and_compliance(spark):
    t = Bridge(spark, "/root/testdata/sf0.001")
    missions = defaultdict(dict)
    stops = defaultdict(int)
    for r in reports.treatment_missions(t).collect():
        missions[r.project_id][r.mission] = (r.area_ha, r.litres, r.minutes, r.distance_m, r.distance_before_m - r.distance_m)
        stops[r.project_id] += 1
    got = {r.project_id: r for r in reports.plan_totals(t).collect()}
    assert got.keys() == missions.keys() and got
    for p, own in missions.items():
        sums = [sum(m[i] for m in own.values()) for i in range(5)]
        assert (got[p].missions, got[p].stops) == (len(own), stops[p])
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(sums, (got[p].area_ha, got[p].litres, got[p].minutes, got[p].distance_m, got[p].saved_m)))
    parts, zones = defaultdict(list), defaultdict(dict)
    for r in reports.compliant_zones(t).collect():
        parts[r.project_id, r.zone].append(r.area_ha)
    for r in reports.treatment_zones(t).collect():
        zones[r.project_id][r.sequence] = r.area_ha
    for r in reports.compliance_report(t).collect():
        own = zones.pop(r.project_id)
        left = {z: parts.get((r.project_id, z), []) for z in own}
        assert (r.zones, r.excluded, r.split) == (len(own), sum(not v for v in left.values()), sum(len(v) > 1 for v in left.values()))
        assert math.isclose(r.excluded_ha, sum(own.values()) - sum(map(sum, left.values())), rel_tol=1e-9, abs_tol=1e-9)
    assert not zones


def test_report_of_odd_flights(spark):
    rows = spark.createDataFrame([("a", "x|y", 1.0), ("a", "z", 2.0), ("a", "b", None), (None, "c", None), (None, None, 4.0), ("e", "q", None)], "flight string, id string, distance double")
    got = {r.flight: r for r in evaluation.flight_report(rows).withColumn("text", evaluation.report_text(F.col("flight"), F.lit("now"))).collect()}
    assert (got["a"].n, got["a"].projected, got["a"].failed, got["a"].p50, got["a"].worst, got["a"].worst_m) == (3, 2, 1, 1.5, ["z", "x|y"], [2.0, 1.0])
    assert (got[None].n, got[None].p50, got[None].worst) == (2, 4.0, [None]) and (got["e"].n, got["e"].p50, got["e"].worst) == (1, None, [])
    assert got["a"].text.endswith("| z | 2.000 |\n| x\\|y | 1.000 |") and got["e"].text.endswith("| n/a | n/a |") and "p50: n/a m" in got["e"].text
    assert evaluation.flight_report(rows.limit(0)).count() == 0
    empty = evaluation.error_summary(rows.limit(0)).first()
    assert (empty.n, empty.p50, empty.rmse) == (0, None, None)


def test_odd_settings_and_texts(spark):
    df = spark.createDataFrame([("{}",), (None,), ('{"maxTemperatureC": 6, "minTemperatureC": 30, "classes": null}',), ("[]",)], "j string")
    got = [r.p for r in df.select(settings.plan_settings(F.col("j")).alias("p")).collect()]
    plain = settings.PlanSettings().held()
    for p in (got[0], got[1], got[3]):
        assert all(p[k] == getattr(plain, k) for k in settings.PLAN_KEYS) and p.classes == [] and p.preferred_launch is None and p.ai and not p.unverified
    assert (got[2].low_temp, got[2].high_temp) == (5, 6)
    shown = spark.range(1).select(text.progress(F.lit(None), F.lit(5)).alias("a"), text.progress(F.lit(9), F.lit(3)).alias("b"), text.progress(F.lit(1), F.lit(None)).alias("c"), text.report_slug(F.lit("")).alias("d"), geo.coordinate_problem(F.lit(None).cast("double"), F.lit(1.0)).alias("e")).first()
    assert (shown.a, shown.b, shown.c) == (0, 100, 0) and shown.d == "unassigned-da39a3e" and "lat=null" in shown.e
    with pytest.raises(PySparkException, match="latitude out of range"):
        spark.range(1).select(geo.asserted_place(F.lit(91.0), F.lit(0.0))).collect()
    assert tuple(spark.range(1).select(geo.asserted_place(F.lit(1.0), F.lit(2.0)).alias("p")).first().p) == (1.0, 2.0)


def test_first_rings(spark):
    ring = lambda x: f'[[{x},0],[{x + 1},0],[{x + 1},1],[{x},0]]'
    polygon = lambda x: f'{{"type":"Polygon","coordinates":[{ring(x)}]}}'
    feature = lambda g: f'{{"type":"Feature","geometry":{g}}}'
    listed = f'{{"type":"FeatureCollection","features":[{feature("null")},{feature(polygon(5))},{feature(polygon(7))}]}}'
    rows = spark.createDataFrame([("c", listed), ("p", polygon(3)), ("n", None), ("g", f'{{"type":"GeometryCollection","geometries":[{polygon(1)}]}}'), ("e", '{"type":"FeatureCollection","features":[]}')], "k string, j string")
    got = {r.k: [g[0].x for g in r.g] for r in rows.select("k", readers.first_rings(F.col("j")).alias("g")).collect()}
    assert got == {"c": [5.0], "p": [3.0], "n": [], "g": [], "e": []}


def test_feed_of_odd_rings(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    labels = spark.createDataFrame([("m", 1, 1, "a", 0.5, ring), ("m", 1, 1, "a", 0.5, ring), ("m", 2, 1, "a", None, []), ("m", 3, 1, "a", None, None), ("m", 4, 9, "a", None, ring), ("m", 5, 2, "a", None, ring)], "source string, id int, asset_id int, class string, confidence double, ring array<struct<x: double, y: double>>")
    images = spark.createDataFrame([(1, -27.0, 153.0, -90.0, 0.0, 0.0, 50.0), (2, -27.0, 153.0, 0.0, 0.0, 0.0, 50.0)], "asset_id int, gps_lat double, gps_lon double, gimbal_pitch double, gimbal_roll double, gimbal_yaw double, up double")
    camera = F.struct(F.lit(100.0).alias("f"), F.lit(5.0).alias("cx"), F.lit(5.0).alias("cy"))
    got = {r.id: r for r in feeds.annotation_feed(labels, images, camera, F.col("up")).collect()}
    assert sorted(got) == [1, 2, 3, 5] and len(got[1].places) == 3 and math.isclose(got[1].centre.lat, -27.0) and math.isclose(got[1].centre.lon, 153.0)
    assert all(got[i].places == [] and got[i].centre is None for i in (2, 3, 5))


def test_signal_changes(spark):
    t = Bridge(spark, "/root/testdata/sf0.01")
    best = {}
    for r in reports._drawn_signals(t).select("survey_id", "id", "species", "confidence", "lat", "lon", "ring").collect():
        key = tuple((v is not None, v) for v in (r.species, r.confidence, r.lat, r.lon))
        if (r.survey_id, r.id) not in best or key < best[r.survey_id, r.id][0]:
            best[r.survey_id, r.id] = key, r
    base, other = ([r for (s, _), (_, r) in best.items() if s == survey] for survey in ("baseline", "comparison"))

    def shared(a, b):
        p, q = ([(f(v.x for v in r.ring), f(v.y for v in r.ring)) for f in (min, max)] for r in (a, b))
        sides = [max(0.0, min(p[1][i], q[1][i]) - max(p[0][i], q[0][i])) for i in (0, 1)]
        areas = [(r[1][0] - r[0][0]) * (r[1][1] - r[0][1]) for r in (p, q)]
        return sides[0] * sides[1] / (sum(areas) - sides[0] * sides[1])

    want = {}
    for d, a, b in pairs(base, other, 8.0, lambda a, b: a.species == b.species):
        overlap = shared(a, b) if a.ring and b.ring else float(d <= 3)
        if d <= 3 or overlap >= 0.1:
            want[a.id, b.id] = 0.7 * d / 8 + 0.3 * (1 - overlap), d
    schema = "id string, species string, confidence double, lat double, lon double, ring array<struct<x: double, y: double>>"
    frame = lambda rows: spark.createDataFrame([(r.id, r.species, r.confidence, r.lat, r.lon, r.ring) for r in rows], schema)
    met = {(r.a, r.b): r.cost for r in temporal.candidates(frame(base), frame(other)).collect()}
    assert met.keys() == want.keys() and any(d > 3 for _, d in want.values())
    assert all(abs(met[k] - want[k][0]) < 1e-6 for k in met)
    taken = set(greedy((c, a, b) for (a, b), c in met.items()))
    found = reports.signal_changes(t).collect()
    assert {(r.baseline_id, r.comparison_id) for r in found if r.change_type == "PERSISTENT"} == taken and any(want[k][1] > 3 for k in taken)
    assert Counter(r.comparison_id for r in found if r.change_type == "NEW") == Counter({r.id for r in other} - {b for _, b in taken})
    assert Counter(r.baseline_id for r in found if r.change_type in ("RESOLVED", "UNOBSERVED")) == Counter({r.id for r in base} - {a for a, _ in taken})
    assert len({r.baseline_id.split(":")[0] for r in found if r.baseline_id}) == 3


def test_signals_with_rings_match_without_rows_of_pairs(spark, monkeypatch):
    """Odd rings too: a triangle, a tilted square, none."""
    rng = random.Random(8)
    shapes = [[(-1, -1), (1, -1), (1, 1), (-1, 1)], [(-1, -1), (1, -1), (0, 1)], [(0, -1), (1, 0), (0, 1), (-1, 0)], None]

    def made(first):
        rows = []
        for i in range(40):
            lat, lon, ring = -27 + rng.random() * 0.0002, 153 + rng.random() * 0.0002, rng.choice(shapes)
            rows.append((first + i, "ab"[i % 2], 0.5, lat, lon, ring and [(lon + x * 0.00004, lat + y * 0.00004) for x, y in ring]))
        return spark.createDataFrame(rows, "id long, species string, confidence double, lat double, lon double, ring array<struct<x: double, y: double>>")

    base, other = made(0), made(100)
    met = temporal.candidates(base, other).collect()
    want = set(greedy((r.cost, r.a, r.b) for r in met))
    images = spark.createDataFrame([], "asset_id long, gps_lat double, gps_lon double, altitude double, camera_fov double")
    monkeypatch.setattr(temporal, "candidates", None)
    found = temporal.changes(base, other, images).where("change_type = 'PERSISTENT'").collect()
    assert {(r.baseline_id, r.comparison_id) for r in found} == want and len(want) > 20 and len(met) > 2 * len(want)


def test_feed_keeps_vertices_in_their_rows(spark):
    labels = spark.createDataFrame([("m", 1, 1, "a", 0.5, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)])], "source string, id int, asset_id int, class string, confidence double, ring array<struct<x: double, y: double>>")
    images = spark.createDataFrame([(1, -27.0, 153.0, -90.0, 0.0, 0.0, 50.0)], "asset_id int, gps_lat double, gps_lon double, gimbal_pitch double, gimbal_roll double, gimbal_yaw double, up double")
    camera = F.struct(F.lit(100.0).alias("f"), F.lit(5.0).alias("cx"), F.lit(5.0).alias("cy"))
    plan = feeds.annotation_feed(labels, images, camera, F.col("up"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "generate" not in plan and plan.count("zip_with(") == 1
