"""Reports, feeds, merges of boxes and what runs are told as text, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo, georef, settings, text
from ..operators import evaluation, feeds, lists, resolution, signals, temporal
from ..sources import readers
from ..sources.bridge import Bridge
from ..storage import scratch
from .analytics import treatment_missions, treatment_zones
from .imagery import _framed, _rays
from .quality import compliant_zones
from .registry import query
from .sources import _located

_ERRORS = """e AS (SELECT flight_session AS flight, detection_id AS id, CASE WHEN confidence IS NOT NULL THEN pow(sin(radians(lat - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(lat)) * pow(sin(radians(lon - gps_lon) / 2), 2) END AS s FROM {detection} d JOIN {asset} a ON d.asset_id = a.asset_id),
  d AS (SELECT flight, id, round(2 * 6371000.0E0 * atan2(sqrt(s), sqrt(1 - s)), 6) AS d FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY d DESC NULLS LAST, id) AS k FROM d),
  f AS (SELECT flight, count(*) AS n, count(d) AS projected, count(*) FILTER (WHERE d IS NULL) AS failed, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.9) AS p90, string_agg(id, ',' ORDER BY k) FILTER (WHERE k <= 5 AND d IS NOT NULL) AS worst,
    string_agg('| ' || id || ' | ' || printf('%.3f', d) || ' |', chr(10) ORDER BY k) FILTER (WHERE k <= 5 AND d IS NOT NULL) AS listed FROM r GROUP BY flight)"""


def _flights(t: Bridge) -> DataFrame:
    distance = F.round(geo.haversine(F.col("gps_lat"), F.col("gps_lon"), F.col("lat"), F.col("lon")), 6)
    rows = t.detection.join(t.asset.drop("project_id", "survey_id"), "asset_id")
    return evaluation.flight_report(rows.select(F.col("flight_session").alias("flight"), F.col("detection_id").alias("id"), F.when(F.col("confidence").isNotNull(), distance).alias("distance")))


@query(f"""WITH {_ERRORS} SELECT flight, n, projected, failed, round(p50, 6) AS p50, round(p90, 6) AS p90, worst FROM f""")
def flight_reports(t: Bridge) -> DataFrame:
    return _flights(t).withColumns({"p50": F.round("p50", 6), "p90": F.round("p90", 6), "worst": F.array_join("worst", ",")}).drop("worst_m")


@query(f"""WITH {_ERRORS} SELECT flight, '# Georeferencing: ' || coalesce(flight, 'unassigned') || chr(10) || chr(10) || 'Generated: 2024-01-01' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '- Count: ' || n || chr(10) || '- Projected: ' || projected || chr(10) || '- Failed: ' || failed || chr(10)
  || '- Centre error p50: ' || printf('%.3f', p50) || ' m' || chr(10) || '- Centre error p90: ' || printf('%.3f', p90) || ' m' || chr(10) || chr(10) || '## Worst errors' || chr(10) || chr(10) || '| Image | Error (m) |' || chr(10) || '|---|---:|' || chr(10) || listed AS report FROM f""")
def flight_report_texts(t: Bridge) -> DataFrame:
    return _flights(t).select("flight", evaluation.report_text(F.coalesce("flight", F.lit("unassigned")), F.lit("2024-01-01")).alias("report"))


_PLAN = """CASE WHEN i % 17 = 0 THEN 'no object' ELSE concat('{"minConfidence":', CAST(i % 300 - 100 AS STRING), 'e-2,"zoneRadiusMeters":', CAST(i % 400 AS STRING), ',"maxZonesPerMission":', CAST(i % 20 AS STRING), '.7,"maxTemperatureC":', CAST(i % 60 AS STRING), ',"minTemperatureC":', CAST(i % 50 - 10 AS STRING),
  CASE WHEN i % 3 = 0 THEN ',"includeUnverified":true,"startLat":"x"' WHEN i % 3 = 1 THEN concat(',"startLat":', CAST(i % 200 - 100 AS STRING), ',"returnToStart":false') ELSE '' END, ',"weatherLookaheadHours":', CAST(i % 100 AS STRING), '.9,"classes":[" a ","","b c"],"preferredLaunchTimeUtc":"', CASE WHEN i % 2 = 0 THEN '2024-01-01T05:00:00Z' ELSE 'soon' END, '"}') END"""


@query("""WITH a AS (SELECT asset_id AS i, asset_id % 17 <> 0 AS good FROM {asset}), h AS (SELECT *, CASE WHEN good THEN greatest(5.0E0, least(50.0E0, i % 60)) ELSE 35.0E0 END AS high, CASE WHEN good THEN least(35.0E0, i % 50 - 10) ELSE 5.0E0 END AS low FROM a), l AS (SELECT *, least(low, high - 1) AS held FROM h)
  SELECT i AS asset_id, CASE WHEN good THEN round(greatest(0.0E0, least(1.0E0, (i % 300 - 100) / 100.0E0)), 9) ELSE 0.45E0 END AS min_confidence, CASE WHEN good THEN greatest(8.0E0, least(250.0E0, i % 400)) ELSE 22.0E0 END AS zone_radius_m, 2.0E0 AS least_detections, CASE WHEN good THEN greatest(1.0E0, i % 20) ELSE 16.0E0 END AS zones_per_mission,
   held AS low_temp, greatest(high, held + 1) AS high_temp, CASE WHEN good THEN greatest(6.0E0, least(72.0E0, i % 100)) ELSE 30.0E0 END AS lookahead_hours, CASE WHEN good AND i % 3 = 1 THEN greatest(-90.0E0, least(90.0E0, i % 200 - 100)) END AS start_lat, CAST(NULL AS DOUBLE) AS start_lon, 1.8E0 AS dose_per_ha,
   good AND i % 3 = 0 AS unverified, NOT good OR i % 3 <> 1 AS return_to_start, true AS weather, CASE WHEN good THEN 'a,b c' ELSE '' END AS classes, CASE WHEN good AND i % 2 = 0 THEN 1704085200 END::BIGINT AS launch FROM l""")
def told_plans(t: Bridge) -> DataFrame:
    found = t.asset.select(F.col("asset_id").alias("i")).select(F.col("i").alias("asset_id"), settings.plan_settings(F.expr(_PLAN)).alias("p"))
    shown = ("zone_radius_m", "least_detections", "zones_per_mission", "low_temp", "high_temp", "lookahead_hours", "start_lat", "start_lon", "dose_per_ha", "unverified", "return_to_start", "weather")
    return found.select("asset_id", F.round("p.min_confidence", 9).alias("min_confidence"), *[f"p.{c}" for c in shown], F.array_join("p.classes", ",").alias("classes"), F.unix_seconds("p.preferred_launch").alias("launch"))


@query("""WITH j AS (SELECT o_orderkey AS id, o_orderkey % 700 - 50 AS done, o_custkey % 5 * 100 AS total, o_orderkey % 7 AS s, o_custkey % 6 AS g FROM {orders})
  SELECT id, CASE WHEN total = 0 THEN 0 ELSE greatest(0, least(100, floor(100 * (done / total::DOUBLE) + 0.5))) END::INTEGER AS progress,
   CASE s WHEN 0 THEN 'Waiting for an inference worker' WHEN 1 THEN 'Search failed' WHEN 2 THEN 'Search cancelled' WHEN 3 THEN CASE WHEN g = 0 THEN 'Ready for review with warnings' ELSE 'Ready for review' END
   ELSE CASE g WHEN 0 THEN 'Preparing source examples' WHEN 1 THEN 'Checking processing requirements' WHEN 2 THEN 'Waiting for GPU capacity' WHEN 3 THEN 'Searching image ' || least(done + 1, total) || ' of ' || total WHEN 4 THEN 'Preparing review suggestions' ELSE 'Searching the image batch' END END AS said FROM j""")
def told_progress(t: Bridge) -> DataFrame:
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    done, total, g = F.col("o_orderkey") % 700 - 50, F.col("o_custkey") % 5 * 100, F.col("o_custkey") % 6
    status = pick(F.col("o_orderkey") % 7, "QUEUED", "FAILED", "CANCELLED", "COMPLETED", "RUNNING", "RUNNING", "RUNNING")
    said = text.stage_text(status, pick(g, "prepare", "estimate", "admit", "run_sam3", "persist", "other"), done, total, g == 0)
    return t.orders.select(F.col("o_orderkey").alias("id"), text.progress(done, total).alias("progress"), said.alias("said"))


@query("""WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN ' ## ' ELSE ' ' || p_type || ' / ' || p_brand || '! ' || CASE WHEN p_partkey % 2 = 0 THEN repeat(p_type || '-', 5) ELSE '' END END AS name FROM {part}),
  s AS (SELECT *, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM n)
  SELECT id, slug[1:80] AS file, CASE WHEN slug = '' THEN 'unassigned' ELSE slug[1:52] END || '-' || sha1(name)[1:7] AS report FROM s""")
def told_slugs(t: Bridge) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 9 == 0, " ## ").otherwise(F.concat(F.lit(" "), "p_type", F.lit(" / "), "p_brand", F.lit("! "), F.when(k % 2 == 0, F.repeat(F.concat("p_type", F.lit("-")), 5)).otherwise("")))
    return t.part.select(k.alias("id"), text.file_slug(name).alias("file"), text.report_slug(name).alias("report"))


@query("""WITH p AS (SELECT asset_id AS id, CASE WHEN asset_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN asset_id % 13 = 0 THEN NULL ELSE asset_id % 200 - 100.5E0 END AS lat, asset_id % 400 - 200.5E0 AS lon, CASE WHEN asset_id % 7 > 0 THEN asset_id % 60000 * 1.0E0 - 1000 END AS up FROM {asset}),
  s AS (SELECT *, CASE WHEN lat IS NULL THEN 'null' WHEN isnan(lat) THEN 'NaN' ELSE lat::VARCHAR END AS told FROM p)
  SELECT id, CASE WHEN lat IS NULL OR isnan(lat) THEN '[SAFETY] computed coordinates are invalid: lat=' || told || ', lon=' || lon || '. This may indicate extreme gimbal angles or invalid altitude values.' WHEN abs(lat) > 90 THEN '[SAFETY] computed latitude out of range: ' || told || '. Valid range is -90 to 90.'
   WHEN abs(lon) > 180 THEN '[SAFETY] computed longitude out of range: ' || lon || '. Valid range is -180 to 180.' END AS problem, up IS NULL OR up BETWEEN -500 AND 50000 AS high_enough FROM s""")
def place_problems(t: Bridge) -> DataFrame:
    i = F.col("asset_id")
    lat = F.when(i % 11 == 0, float("nan")).when(i % 13 == 0, None).otherwise(i % 200 - 100.5)
    up = F.when(i % 7 > 0, i % 60_000 * 1.0 - 1000)
    return t.asset.select(i.alias("id"), geo.coordinate_problem(lat, i % 400 - 200.5).alias("problem"), geo.valid_altitude(up).alias("high_enough"))


@query("""SELECT asset_id, asset_id % 2 = 0 AND asset_id % 3 = 0 AS has_calibration, asset_id % 4 = 0 AND asset_id % 5 > 0 AS has_laser, asset_id % 6 = 0 AS has_dewarp, CASE WHEN asset_id % 2 = 0 THEN 3000.0E0 END AS focal, CASE WHEN asset_id % 2 = 1 THEN 70.0E0 END AS fov,
  round(sqrt(pow(gps_lat - center_lat, 2) + pow(gps_lon - center_lon, 2)) * 111111.0E0, 6) AS shift_m FROM {asset} a JOIN {project} p ON a.project_id = p.project_id""")
def metadata_states(t: Bridge) -> DataFrame:
    i = F.col("asset_id")
    said: dict[str, Column] = {
        "CalibratedFocalLength": F.when(i % 2 == 0, "3000"), "drone-dji:CalibratedOpticalCenterX": F.when(i % 3 == 0, "1900"), "CalibratedOpticalCenterY": F.lit(" 1500 "), "LRFTargetDistance": F.when(i % 4 == 0, "55.5").when(i % 4 == 1, "0"), "LRFTargetLat": F.when(i % 5 > 0, "-27"),
        "drone-dji:LRFTargetLon": F.lit("153"), "DewarpData": F.when(i % 6 == 0, "2024;1").otherwise(" "), "FieldOfView": F.lit("wide"), "CameraFOV": F.when(i % 2 == 1, "70"),
    }
    state = georef.precision_status(F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)]))
    shift = georef.place_shift(F.col("gps_lat"), F.col("gps_lon"), F.col("center_lat"), F.col("center_lon"))
    found = t.asset.join(t.project, "project_id").select("asset_id", state.alias("s"), F.round(shift, 6).alias("shift_m"))
    return found.select("asset_id", "s.has_calibration", "s.has_laser", "s.has_dewarp", "s.focal", "s.fov", "shift_m")


@query("""WITH b AS (SELECT min(ts) + INTERVAL 40 HOUR AS now FROM {forecast}) SELECT epoch(ts)::BIGINT AS at, least(60.0E0, wind * 10) AS wind, least(80.0E0, gust * 10) AS gust, CASE WHEN hour(ts) % 5 = 0 THEN 0.0E0 ELSE precip END AS precip, greatest(-50.0E0, temp - 60) AS temp
  FROM {forecast} CROSS JOIN b WHERE ts BETWEEN now - INTERVAL 1 HOUR AND now + INTERVAL 72 HOUR""")
def forecast_hours(t: Bridge) -> DataFrame:
    """The forecast's days as JSON answers of a weather service, written and read back."""
    hour = F.struct("ts", (F.col("wind") * 10).alias("wind"), (F.col("gust") * 10).alias("gust"), F.when(F.hour("ts") % 5 > 0, F.col("precip")).alias("precip"), (F.col("temp") - 60).alias("temp"))
    days = t.forecast.groupBy(F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(hour)).alias("h"))  # a day has 24 hours
    path = scratch(t.spark, "forecast")
    column = lambda c: F.transform("h", lambda x: x[c])
    days.select(F.transform("h", lambda x: F.date_format(x.ts, "yyyy-MM-dd'T'HH:mm")).alias("time"), *[column(c).alias(c) for c in ("wind", "gust", "precip", "temp")]).write.json(path)
    back = t.spark.read.schema("time array<string>, wind array<double>, gust array<double>, precip array<double>, temp array<double>").json(path)
    now = t.forecast.agg(F.date_format(F.min("ts") + F.expr("INTERVAL 40 HOURS"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    return readers.hourly_forecast(back, now).select(F.unix_seconds("ts").alias("at"), "wind", "gust", "precip", "temp")


@query("""WITH s AS (SELECT c_custkey AS session_id, c_custkey % 3 > 0 AS batch, CASE WHEN c_custkey % 4 = 0 THEN [c_custkey, c_custkey + 1] END AS own, CASE WHEN c_custkey % 5 > 0 THEN [c_custkey % 1000, c_custkey % 1000 + 1] END AS jobs FROM {customer}),
  j AS (SELECT session_id, unnest(jobs) AS job_id FROM s WHERE batch AND own IS NULL)
  SELECT session_id, unnest(own)::BIGINT AS asset_id FROM s UNION SELECT session_id, asset_id::BIGINT FROM j JOIN (SELECT pending_id % 1000 AS job_id, asset_id FROM {pending}) p ON j.job_id = p.job_id""")
def session_scopes(t: Bridge) -> DataFrame:
    k = F.col("c_custkey")
    none = F.array().cast(f"array<{t.customer.schema['c_custkey'].dataType.simpleString()}>")
    sessions = t.customer.select(k.alias("session_id"), F.when(k % 3 > 0, "batch_review").otherwise("single").alias("workflow"), F.when(k % 4 == 0, F.array(k, k + 1)).when(k % 4 == 1, none).alias("asset_ids"), F.when(k % 5 > 0, F.array(k % 1000, k % 1000 + 1)).alias("job_ids"))
    found = readers.session_assets(sessions, t.pending.select((F.col("pending_id") % 1000).alias("job_id"), "asset_id"))
    return found.withColumn("asset_id", F.col("asset_id").cast("long"))


_ONE = "o AS (SELECT detection_id AS id, asset_id, confidence, verified, x1, y1, x2, y2 FROM {detection} WHERE confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY asset_id, confidence, verified, x1, y1, x2, y2) = 1)"


def _one(t: Bridge) -> DataFrame:
    four = ("x1", "y1", "x2", "y2")
    rows = t.detection.where("confidence IS NOT NULL").groupBy(F.col("detection_id").alias("id")).agg(F.min(F.struct("asset_id", "confidence", "verified", *four)).alias("r"))
    return rows.select("id", "r.*")


@query(f"""WITH {_ONE}, p AS (SELECT a.asset_id, a.id AS box, b.id AS candidate, b.confidence AS score, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS o, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM o a JOIN o b ON a.asset_id = b.asset_id WHERE a.verified AND NOT b.verified),
  best AS (SELECT * FROM p WHERE o > 0 AND o / (s - o + 0.0E0) >= 0.1E0 QUALIFY row_number() OVER (PARTITION BY box ORDER BY o / (s - o + 0.0E0) DESC, candidate) = 1)
  SELECT asset_id, box AS id, score AS confidence FROM best UNION ALL SELECT asset_id, id, confidence FROM o WHERE NOT verified AND id NOT IN (SELECT candidate FROM best)""")
def refined_boxes(t: Bridge) -> DataFrame:
    rows = _one(t)
    pick = lambda which: rows.where(which).drop("verified")
    return resolution.merge_refined(pick("NOT verified"), pick("verified")).select("asset_id", "id", "confidence")


_BOTH = "greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1))"
_AREAS = "(k.x2 - k.x1) * (k.y2 - k.y1)", "(r.x2 - r.x1) * (r.y2 - r.y1)"


@query(f"""WITH RECURSIVE {_ONE}, r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY verified DESC, confidence DESC, id) AS n, dense_rank() OVER (ORDER BY asset_id) AS g FROM o WHERE x2 > x1 AND y2 > y1),
  a AS (SELECT g, coalesce(list({{'n': n, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY n) FILTER (WHERE verified), []) AS own, count(*) FILTER (WHERE verified) AS m FROM r GROUP BY g),
  w AS (SELECT g, m AS n, own AS kept, own FROM a UNION ALL SELECT w.g, r.n, CASE WHEN len(w.kept) < 3 AND (len(w.own) = 0 OR len(list_filter(w.own, lambda k: {_BOTH} / (least({_AREAS[0]}, {_AREAS[1]}) + 0.0E0) >= 0.2E0)) > 0)
    AND len(list_filter(w.kept, lambda k: {_BOTH} / ({_AREAS[0]} + {_AREAS[1]} - {_BOTH} + 0.0E0) >= 0.9E0)) = 0 THEN list_append(w.kept, {{'n': r.n, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) ELSE w.kept END, w.own FROM w JOIN r ON r.g = w.g AND r.n = w.n + 1),
  last AS (SELECT g, kept[1:3] AS kept FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC) = 1), k AS (SELECT g, unnest(kept).n AS n FROM last)
  SELECT asset_id, id, verified AS anchor FROM r JOIN k ON r.g = k.g AND r.n = k.n""")
def anchored_boxes(t: Bridge) -> DataFrame:
    rows = _one(t)
    pick = lambda which: rows.where(which).drop("verified")
    return resolution.merge_anchors(pick("verified"), pick("NOT verified"), most=3).select("asset_id", "id", "anchor")


@query(f"""WITH {_rays("d.class_name, d.verified, d.x1 bx1, d.y1 by1, d.x2 bx2, d.y2 by2, n, CASE WHEN n = 4 THEN (d.x1 + d.x2) / 2.0E0 WHEN n IN (1, 2) THEN d.x2 ELSE d.x1 END + 0.0E0 x, CASE WHEN n = 4 THEN (d.y1 + d.y2) / 2.0E0 WHEN n IN (2, 3) THEN d.y2 ELSE d.y1 END + 0.0E0 y", "CROSS JOIN (VALUES (0), (1), (2), (3), (4)) k(n) WHERE NOT d.rejected AND (d.verified OR d.user_corrected)")},
  q AS (SELECT DISTINCT detection_id, class_name, verified, bx1, by1, bx2, by2, n, CASE WHEN offset_m <= most THEN lat_e7 END AS a, CASE WHEN offset_m <= most THEN lon_e7 END AS o FROM pl)
  SELECT detection_id AS id, CASE WHEN verified THEN 'manual' ELSE 'suggestion' END AS source, class_name AS class, count(a) FILTER (WHERE n < 4) AS points, coalesce(sum(a) FILTER (WHERE n < 4), 0)::BIGINT AS lats, coalesce(sum(o) FILTER (WHERE n < 4), 0)::BIGINT AS lons, count(a) > 0 AS placed, CASE WHEN count(a) FILTER (WHERE n < 4) = 4 THEN max(a) FILTER (WHERE n = 4) END AS lat_e7
  FROM q GROUP BY detection_id, class_name, verified, bx1, by1, bx2, by2""")
def annotation_feed(t: Bridge) -> DataFrame:
    """Accepted labels with the places of their rings."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    good = t.detection.where("NOT rejected AND (verified OR user_corrected)")
    labels = good.select(F.when(F.col("verified"), "manual").otherwise("suggestion").alias("source"), F.col("detection_id").alias("id"), "asset_id", F.col("class_name").alias("class"), F.lit(None).cast("double").alias("confidence"), F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2")).alias("ring"))
    _, camera = _framed(t)
    most = georef.most_offset(F.col("altitude"), F.col("camera_fov"), F.col("image_w"), F.col("image_h"))
    found = feeds.annotation_feed(labels, t.asset, camera, F.col("altitude"), most)
    e7 = lambda c: F.round(c * 10_000_000).cast("long")
    total = lambda c: F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + e7(p[c]))
    return found.select("id", "source", "class", F.size("places").cast("long").alias("points"), total("lat").alias("lats"), total("lon").alias("lons"), F.col("centre").isNotNull().alias("placed"), F.when(F.size("places") == 4, e7(F.col("centre.lat"))).alias("lat_e7"))


def _drawn_signals(t: Bridge) -> DataFrame:
    """Signals of all three sources by survey; detections have a square of 0.00008 degrees around them, other labels what they were drawn with."""
    manual, pending = _located(t)
    p = lambda x, y: F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y"))
    square = F.array(p(-0.00004, -0.00004), p(0.00004, -0.00004), p(0.00004, 0.00004), p(-0.00004, 0.00004))
    found = signals.survey_signals(t.detection.withColumn("ring", square), manual, pending, 0.45)
    return found.withColumn("id", F.concat_ws(":", "source", "id"))


@query()
def signal_changes(t: Bridge) -> DataFrame:
    """Changes between the surveys of detections, labels by hand and suggestions together, matched by their rings too."""
    rows = _drawn_signals(t)
    of = lambda survey: rows.where(F.col("survey_id") == survey).select("id", "species", "confidence", "lat", "lon", "ring")
    return temporal.with_risk(temporal.changes(of("baseline"), of("comparison"), t.asset.where("survey_id = 'comparison'")))


@query()
def calibrated_objects(t: Bridge) -> DataFrame:
    """Objects of any class seen in several images, as the calibration of cameras takes them."""
    good = t.detection.where("NOT rejected AND (verified OR user_corrected)")
    return resolution.calibration_points(good.select(F.col("detection_id").alias("id"), "asset_id", "confidence", "lat", "lon", "created_at"))


@query()
def plan_totals(t: Bridge) -> DataFrame:
    """What each project's treatment plan comes to, and the metres that its better routes save."""
    return lists.plan_totals(treatment_missions(t))


@query()
def compliance_report(t: Bridge) -> DataFrame:
    """Zones left out or split by the layers of each project, and the hectares taken out."""
    return lists.compliance_counts(treatment_zones(t), compliant_zones(t))
