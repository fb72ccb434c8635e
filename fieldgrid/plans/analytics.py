"""Geometry, georeferencing, weather, datasets, change, entity resolution and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import box, geo, georef, text, weather
from ..operators import dataset, planning, resolution, spatial, temporal
from ..operators.reporting import accepted
from ..sources.bridge import Bridge
from .registry import query


def _good(t: Bridge) -> DataFrame:
    return t.detection.where(accepted() & (F.col("confidence") >= 0.45))


def _signals(t: Bridge, survey: str) -> DataFrame:
    return _good(t).where(F.col("survey_id") == survey).select(F.col("detection_id").alias("id"), F.col("class_name").alias("species"), "confidence", "lat", "lon", "asset_id", "created_at")


_HAVERSINE = "2 * 6371000.0E0 * atan2(sqrt(s), sqrt(1 - s))"
_S = "pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2)"
_CELLS = """b AS (SELECT *, CAST(floor(lat / 0.0002E0) AS BIGINT) cy, CAST(floor(lon / 0.0003E0) AS BIGINT) cx FROM {detection} WHERE NOT rejected AND (verified OR user_corrected) AND confidence >= 0.45),
  n AS (SELECT * FROM (VALUES (-1), (0), (1)) t(dv)), l AS (SELECT b.*, cy + n1.dv ny, cx + n2.dv nx FROM b CROSS JOIN n n1 CROSS JOIN n n2)"""


@query(f"""WITH {_CELLS}, j AS (SELECT l.class_name, l.detection_id i, r.detection_id k, {_S} s FROM l JOIN b r ON l.class_name = r.class_name AND l.ny = r.cy AND l.nx = r.cx WHERE l.survey_id = 'baseline' AND r.survey_id = 'comparison')
  SELECT class_name AS species, count(*) AS pairs8, count(*) FILTER (WHERE {_HAVERSINE} <= 3) AS pairs3, count(DISTINCT i) AS lhs, count(DISTINCT k) AS rhs FROM j WHERE {_HAVERSINE} <= 8 GROUP BY class_name""")
def proximity_pairs(t: Bridge) -> DataFrame:
    met = spatial.near_pairs(_signals(t, "baseline"), _signals(t, "comparison"), 8.0, ("species",))
    return met.groupBy("species").agg(F.count("*").alias("pairs8"), F.count_if(F.col("distance") <= 3).alias("pairs3"), F.countDistinct("a").alias("lhs"), F.countDistinct("b").alias("rhs"))


@query(f"""WITH {_CELLS}, j AS (SELECT l.detection_id i, {_S} s FROM l JOIN b r ON l.ny = r.cy AND l.nx = r.cx WHERE l.detection_id <> r.detection_id AND l.survey_id = 'comparison' AND r.survey_id = 'comparison'),
  c AS (SELECT i, count(*) AS n FROM j WHERE {_HAVERSINE} <= 15 GROUP BY i) SELECT coalesce(c.n, 0) AS neighbours, count(*) AS signals FROM b LEFT JOIN c ON b.detection_id = c.i WHERE b.survey_id = 'comparison' GROUP BY 1""")
def neighbour_histogram(t: Bridge) -> DataFrame:
    return spatial.neighbour_counts(_signals(t, "comparison"), 15.0).groupBy("neighbours").agg(F.count("*").alias("signals"))


@query(f"""WITH {_CELLS}, j AS (SELECT l.detection_id i, r.detection_id k, {_S} s FROM l JOIN b r ON l.class_name = r.class_name AND l.ny = r.cy AND l.nx = r.cx WHERE l.survey_id = 'baseline' AND r.survey_id = 'comparison')
  SELECT i AS a, min_by(k, ({_HAVERSINE}, k)) AS b FROM j WHERE {_HAVERSINE} <= 8 GROUP BY i""")
def nearest_truth(t: Bridge) -> DataFrame:
    met = spatial.near_pairs(_signals(t, "baseline"), _signals(t, "comparison"), 8.0, ("species",))
    return met.groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"))


@query()
def temporal_changes(t: Bridge) -> DataFrame:
    return temporal.with_risk(temporal.changes(_signals(t, "baseline"), _signals(t, "comparison"), t.asset.where("survey_id = 'comparison'")))


@query()
def temporal_summary(t: Bridge) -> DataFrame:
    return temporal.summary(temporal_changes(t))


@query()
def temporal_hotspots(t: Bridge) -> DataFrame:
    return temporal.hotspots(temporal_changes(t))


_RADIUS = "CASE WHEN altitude IS NULL OR camera_fov IS NULL THEN 25.0E0 ELSE greatest(12.0E0, least(80.0E0, (CASE WHEN altitude > 0 THEN altitude ELSE 30.0E0 END) * tan(radians(greatest(1.0E0, least(170.0E0, camera_fov))) / 2))) END"


@query(f"""SELECT asset_id, CAST(round({_RADIUS} * 1000) AS BIGINT) AS radius_mm FROM {{asset}}""")
def coverage_radii(t: Bridge) -> DataFrame:
    return t.asset.select("asset_id", F.round(geo.coverage_radius(F.col("altitude"), F.col("camera_fov")) * 1000).cast("long").alias("radius_mm"))


@query("""WITH c AS (SELECT d.detection_id, a.gps_lat, a.gps_lon, a.altitude, radians(a.gimbal_pitch) p, radians(a.gimbal_yaw) w, a.image_w / (2 * tan(radians(a.camera_fov) / 2)) f, (d.x1 + d.x2) / 2.0E0 x, (d.y1 + d.y2) / 2.0E0 y, a.image_w / 2.0E0 cx, a.image_h / 2.0E0 cy
    FROM {detection} d JOIN {asset} a ON d.asset_id = a.asset_id),
  r AS (SELECT *, (x - cx) / f tx, (y - cy) / f ty FROM c),
  v AS (SELECT *, cos(p) + ty * sin(p) AS ahead, sin(p) - ty * cos(p) AS up FROM r),
  e AS (SELECT *, ahead * sin(w) + tx * cos(w) AS east, ahead * cos(w) - tx * sin(w) AS north FROM v),
  g AS (SELECT *, up < -0.05E0 * sqrt(east * east + north * north + up * up) AND sin(p) < -0.05E0 AS good FROM e)
  SELECT detection_id, CASE WHEN good THEN CAST(round(altitude / -up * east * 100) AS BIGINT) END AS east_cm, CASE WHEN good THEN CAST(round(altitude / -up * north * 100) AS BIGINT) END AS north_cm FROM g""")
def projected_offsets(t: Bridge) -> DataFrame:
    rows = t.detection.join(t.asset.drop("project_id", "survey_id"), "asset_id")
    none = F.lit(None).cast("double")
    camera = georef.intrinsics(none, none, none, F.col("image_w"), F.col("image_h"), F.col("camera_fov"))
    placed = rows.select("detection_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), camera.alias("camera"), "gimbal_pitch", "gimbal_roll", "gimbal_yaw", "altitude")
    o = georef.ground_offset(F.col("x"), F.col("y"), F.col("camera"), F.col("gimbal_pitch"), F.col("gimbal_roll"), F.col("gimbal_yaw"), F.col("altitude"))
    at = placed.select("detection_id", o.alias("o"))
    return at.select("detection_id", F.round(F.col("o.east") * 100).cast("long").alias("east_cm"), F.round(F.col("o.north") * 100).cast("long").alias("north_cm"))


@query("""SELECT a.asset_id, CASE WHEN flight_session IS NULL THEN 'missing' WHEN altitude < 30 THEN 'low' WHEN gimbal_pitch > -75 THEN 'medium' ELSE 'high' END AS quality,
   CASE WHEN flight_session IS NULL THEN 'gps' ELSE array_to_string(list_filter([CASE WHEN altitude < 30 THEN 'altitude' END, CASE WHEN gimbal_pitch > -75 THEN 'gimbal angles' END], lambda x: x IS NOT NULL), ',') END AS missing FROM {asset} a""")
def geo_quality(t: Bridge) -> DataFrame:
    yes = F.lit(True)
    found = georef.geo_quality(F.col("flight_session").isNotNull(), F.col("image_w") > 0, F.col("altitude") >= 30, F.col("gimbal_pitch") <= -75, F.col("camera_fov").isNotNull(), yes, F.lit(False))
    return t.asset.select("asset_id", found.alias("q")).select("asset_id", "q.quality", F.array_join("q.missing", ",").alias("missing"))


@query("""SELECT class_name, regexp_replace(regexp_replace(trim(lower(class_name)), '\\s+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS clean, count(*) AS n FROM {detection} GROUP BY class_name""")
def sanitised_classes(t: Bridge) -> DataFrame:
    return t.detection.groupBy("class_name").agg(F.count("*").alias("n")).select("class_name", text.sanitised_class(F.col("class_name")).alias("clean"), "n")


_TYPES = ["Lantana", " lantana  camara", "W", "acacia", "BELLYACHE-bush", "pine sapling 3", "rubber_bush", "weeping fig", "", "Other", "sap", "unknown thing"]


@query("""SELECT detection_id, CASE detection_id % 12 WHEN 0 THEN 'Lantana' WHEN 1 THEN 'Lantana' WHEN 2 THEN 'Wattle' WHEN 3 THEN 'Wattle' WHEN 4 THEN 'Bellyache Bush' WHEN 5 THEN 'Pine Sapling' WHEN 6 THEN 'Calitropis' WHEN 7 THEN 'Weeping Fig' WHEN 10 THEN 'Pine Sapling' ELSE 'Unknown' END AS type FROM {detection}""")
def detection_types(t: Bridge) -> DataFrame:
    return t.detection.select("detection_id", text.detection_type(F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("detection_id") % len(_TYPES) + 1).cast("int"))).alias("type"))


@query("""SELECT detection_id, round(least(1.0E0, greatest(0.0E0, (x1 + x2) / 2.0E0 / 4000)), 9) AS x, round(least(1.0E0, greatest(0.0E0, (y1 + y2) / 2.0E0 / 3000)), 9) AS y, round(least(1.0E0, greatest(0.0E0, (x2 - x1) / 4000.0E0)), 9) AS w, round(least(1.0E0, greatest(0.0E0, (y2 - y1) / 3000.0E0)), 9) AS h
  FROM {detection} WHERE NOT rejected AND (verified OR user_corrected) AND coalesce(confidence, 0) >= 0.25""")
def yolo_boxes(t: Bridge) -> DataFrame:
    found = dataset.boxed_labels(t.detection, 0.25)
    return found.select(F.col("id").alias("detection_id"), *[F.round(c, 9).alias(c) for c in ("x", "y", "w", "h")])


@query("""WITH b AS (SELECT asset_id, detection_id, class_name, x1, y1, x2, y2, row_number() OVER (PARTITION BY asset_id, class_name, x1, y1, x2, y2 ORDER BY detection_id) AS n FROM {detection} WHERE NOT rejected AND (verified OR user_corrected))
  SELECT class_name, count(*) AS labels, count(DISTINCT asset_id) AS images FROM b WHERE n = 1 GROUP BY class_name""")
def dataset_classes(t: Bridge) -> DataFrame:
    found = dataset.one_of_equal(dataset.boxed_labels(t.detection))
    names = t.detection.select("class_name").distinct().withColumn("class", text.sanitised_class(F.col("class_name")))
    return found.groupBy("class").agg(F.count("*").alias("labels"), F.countDistinct("asset_id").alias("images")).join(names, "class").select("class_name", "labels", "images")


@query("""WITH c AS (SELECT count(*) AS n FROM {asset}) SELECT 'train' AS split, floor(n * 0.7E0)::BIGINT AS images FROM c UNION ALL SELECT 'val', floor(n * 0.2E0)::BIGINT FROM c UNION ALL SELECT 'test', n - floor(n * 0.7E0)::BIGINT - floor(n * 0.2E0)::BIGINT FROM c""")
def dataset_split(t: Bridge) -> DataFrame:
    return dataset.split(t.asset.select("asset_id")).groupBy("split").agg(F.count("*").alias("images"))


@query("""WITH l AS (SELECT asset_id, detection_id AS id, regexp_replace(regexp_replace(trim(lower(class_name)), '\\s+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS class, least(1.0E0, greatest(0.0E0, (x1 + x2) / 2.0E0 / 4000)) AS x, least(1.0E0, greatest(0.0E0, (y1 + y2) / 2.0E0 / 3000)) AS y,
    least(1.0E0, greatest(0.0E0, (x2 - x1) / 4000.0E0)) AS w, least(1.0E0, greatest(0.0E0, (y2 - y1) / 3000.0E0)) AS h FROM {detection} WHERE NOT rejected AND (verified OR user_corrected)),
  o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY asset_id, class, round(x, 4), round(y, 4), round(w, 4), round(h, 4) ORDER BY id) = 1),
  j AS (SELECT asset_id, id, '{"id":' || id || ',"class":"' || class || '","x":' || CAST(CAST(x AS DECIMAL(10,6)) AS VARCHAR) || ',"y":' || CAST(CAST(y AS DECIMAL(10,6)) AS VARCHAR) || ',"w":' || CAST(CAST(w AS DECIMAL(10,6)) AS VARCHAR) || ',"h":' || CAST(CAST(h AS DECIMAL(10,6)) AS VARCHAR) || '}' AS j FROM o)
  SELECT asset_id, count(*) AS n_labels, sha256(string_agg(j, chr(10) ORDER BY id, j)) AS checksum FROM j GROUP BY asset_id""")
def dataset_manifest(t: Bridge) -> DataFrame:
    return dataset.manifest(dataset.one_of_equal(dataset.boxed_labels(t.detection)))


@query("""WITH l AS (SELECT asset_id, class_name AS class, survey_id, confidence FROM {detection}), a AS (SELECT * FROM l WHERE confidence >= 0.5), b AS (SELECT * FROM l WHERE confidence >= 0.98)
  SELECT (SELECT count(DISTINCT asset_id) FROM a) AS images_a, (SELECT count(DISTINCT asset_id) FROM b) AS images_b, (SELECT count(*) FROM (SELECT asset_id FROM a INTERSECT SELECT asset_id FROM b)) AS images_both,
  coalesce((SELECT string_agg(class, ',' ORDER BY class) FROM (SELECT class FROM b EXCEPT SELECT class FROM a)), '') AS added, coalesce((SELECT string_agg(class, ',' ORDER BY class) FROM (SELECT class FROM a EXCEPT SELECT class FROM b)), '') AS removed""")
def version_comparison(t: Bridge) -> DataFrame:
    of = lambda least: t.detection.where(F.col("confidence") >= least).select("asset_id", F.col("class_name").alias("class"))
    return dataset.compare_versions(of(0.5), of(0.98))


@query("""SELECT asset_id, count(*) AS tiles, max(x) AS last_x, max(y) AS last_y, sum(w * h)::BIGINT AS pixels FROM (SELECT asset_id, x, y, least(1536, image_w - x) AS w, least(1536, image_h - y) AS h FROM {asset}, (VALUES (0), (1024), (2048), (2464)) tx(x), (VALUES (0), (1024), (1464)) ty(y)) GROUP BY asset_id""")
def tile_plans(t: Bridge) -> DataFrame:
    tiles = t.asset.select("asset_id", F.explode(box.tile_plan(F.col("image_w"), F.col("image_h"))).alias("t"))
    return tiles.groupBy("asset_id").agg(F.count("*").alias("tiles"), F.max("t.x").alias("last_x"), F.max("t.y").alias("last_y"), F.sum((F.col("t.width") * F.col("t.height")).cast("long")).alias("pixels"))


@query("""WITH p AS (SELECT a.detection_id i, b.detection_id k, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS both_, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS bb
  FROM {detection} a JOIN {detection} b ON a.asset_id = b.asset_id AND a.detection_id < b.detection_id) SELECT i, k, round(both_ / (aa + bb - both_ + 0.0E0), 9) AS iou FROM p WHERE both_ > 0""")
def overlapping_boxes(t: Bridge) -> DataFrame:
    b = t.detection.select("asset_id", "detection_id", box.corner(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("b"))
    pairs = b.alias("p").join(b.alias("q"), F.expr("p.asset_id = q.asset_id AND p.detection_id < q.detection_id"))
    iou = box.iou(F.col("p.b"), F.col("q.b"))
    return pairs.select(F.col("p.detection_id").alias("i"), F.col("q.detection_id").alias("k"), F.round(iou, 9).alias("iou")).where("iou > 0")


def _boxes(t: Bridge) -> DataFrame:
    return t.detection.select(F.col("detection_id").alias("id"), "asset_id", "class_name", "confidence", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])


def _nms(keys: str, o: str, test: str, most: int) -> str:
    """The greedy walk of each group as a recursion over its ranks, with the boxes kept so far as a list."""
    both = "greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1))"
    a, b = "(k.x2 - k.x1) * (k.y2 - k.y1)", "(r.x2 - r.x1) * (r.y2 - r.y1)"
    share = f"{both} / ({a} + {b} - {both} + 0.0E0)" if o == "iou" else f"{both} / (least({a}, {b}) + 0.0E0)"
    return f"""WITH RECURSIVE r AS (SELECT detection_id AS id, asset_id, class_name, confidence, x1, y1, x2, y2, row_number() OVER (PARTITION BY {keys} ORDER BY confidence DESC, detection_id, x1, y1, x2, y2) AS n, dense_rank() OVER (ORDER BY {keys}) AS g FROM {{detection}} WHERE confidence IS NOT NULL),
  w(g, n, kept) AS (SELECT DISTINCT g, 0::BIGINT, []::STRUCT(n BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[] FROM r
    UNION ALL SELECT w.g, r.n, CASE WHEN len(w.kept) < {most} AND len(list_filter(w.kept, lambda k: {share} {test})) = 0 THEN list_append(w.kept, {{'n': r.n, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) ELSE w.kept END FROM w JOIN r ON r.g = w.g AND r.n = w.n + 1),
  last AS (SELECT g, kept FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC) = 1), k AS (SELECT g, unnest(kept).n AS n FROM last)
  SELECT r.id, asset_id, class_name, confidence, x1 + 0.0E0 AS x1, y1 + 0.0E0 AS y1, x2 + 0.0E0 AS x2, y2 + 0.0E0 AS y2 FROM r JOIN k ON r.g = k.g AND r.n = k.n"""


@query(_nms("asset_id, class_name", "iou", ">= 0.45E0", 1_000_000))
def suppressed_boxes(t: Bridge) -> DataFrame:
    return resolution.suppress(_boxes(t), ("asset_id", "class_name"), 0.45)


@query(_nms("asset_id", "iou", "> 0.5E0", 400))
def suppressed_concepts(t: Bridge) -> DataFrame:
    return resolution.suppress(_boxes(t), ("asset_id",), 0.5, inclusive=False, budget=400)


@query(_nms("asset_id", "smaller", "> 0.5E0", 1_000_000))
def merged_tiles(t: Bridge) -> DataFrame:
    return resolution.suppress(_boxes(t), ("asset_id",), 0.5, "smaller", inclusive=False)


@query()
def deduplicated_detections(t: Bridge) -> DataFrame:
    found = _good(t).withColumnRenamed("detection_id", "id").select("id", "asset_id", "class_name", "confidence", "lat", "lon", "created_at")
    return resolution.representatives(found, resolution.duplicate_groups(found))


@query()
def counted_objects(t: Bridge) -> DataFrame:
    found = _good(t).select(F.col("detection_id").alias("id"), "lat", "lon", "created_at")
    return resolution.leader_counts(found, 2.0).groupBy("leader").agg(F.count("*").alias("n"))


@query()
def image_biases(t: Bridge) -> DataFrame:
    found = _good(t).withColumnRenamed("detection_id", "id").select("id", "asset_id", "class_name", "confidence", "lat", "lon", "created_at")
    return resolution.image_bias(found)


_W = "greatest(0.0E0, least(1.5E0, wind / 8.0E0 * 0.35E0 + gust / 12.0E0 * 0.35E0 + precip / 40.0E0 * 0.2E0 + greatest(0.0E0, least(1.5E0, (CASE WHEN temp < 5 THEN 5.0E0 - temp WHEN temp > 35 THEN temp - 35.0E0 ELSE 0.0E0 END) / 8)) * 0.1E0))"
_SEVERITY = f"CASE WHEN wind > 8.8E0 OR gust > 13.2E0 OR precip > 60 OR temp < 3 OR temp > 37 OR {_W} >= 1 THEN 2 WHEN {_W} >= 0.75E0 OR wind > 8 OR gust > 12 OR precip > 40 THEN 1 ELSE 0 END"


@query(f"SELECT ts, round(least(1.0E0, {_W}), 9) AS score, {_SEVERITY} AS severity FROM {{forecast}}")
def weather_points(t: Bridge) -> DataFrame:
    four = [F.col(c) for c in ("wind", "gust", "precip", "temp")]
    return t.forecast.select("ts", F.round(F.least(F.lit(1.0), weather.raw_score(*four)), 9).alias("score"), weather.severity(*four).alias("severity"))


@query(f"""WITH f AS (SELECT *, least(1.0E0, {_W}) AS score, {_SEVERITY} AS severity FROM {{forecast}}), w AS (SELECT n_nationkey AS id, (SELECT min(ts) FROM f) + INTERVAL (n_nationkey * 37) MINUTE - INTERVAL 90 MINUTE AS s, (SELECT min(ts) FROM f) + INTERVAL (n_nationkey * 37 + n_nationkey * 11) MINUTE - INTERVAL 90 MINUTE AS e FROM {{nation}}),
  hit AS (SELECT w.id, f.* FROM w JOIN f ON f.ts BETWEEN w.s AND w.e), lone AS (SELECT * FROM w WHERE id NOT IN (SELECT id FROM hit)),
  near AS (SELECT l.id, f.* FROM lone l CROSS JOIN f QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY abs(epoch_us(f.ts) - epoch_us(l.s)), f.ts) = 1), h AS (SELECT * FROM hit UNION ALL SELECT * FROM near)
  SELECT id, count(*) AS hours, round(least(1.0E0, 0.7E0 * max(score) + 0.3E0 * avg(score)), 6) AS score, max(severity) AS severity, max(wind) AS max_wind, min(temp) AS min_temp FROM h GROUP BY id""")
def weather_windows(t: Bridge) -> DataFrame:
    first = t.forecast.agg(F.min("ts").alias("t0"))
    minute = lambda n: F.timestamp_micros(F.unix_micros("t0") + n.cast("long") * F.lit(60_000_000).cast("long"))
    k = F.col("n_nationkey")
    windows = t.nation.join(F.broadcast(first)).select(k.alias("id"), minute(k * 37 - 90).alias("start"), minute(k * 48 - 90).alias("end"))
    found = planning.assess(planning.window_hours(windows, t.forecast))
    return found.select("id", "hours", F.round("score", 6).alias("score"), "severity", "max_wind", "min_temp")


def _points(t: Bridge) -> DataFrame:
    return _good(t).select("project_id", F.col("class_name").alias("species"), "confidence", "lat", "lon")


@query()
def treatment_zones(t: Bridge) -> DataFrame:
    doses = t.part.select(F.col("p_type").alias("species")).distinct().where("species LIKE '%STEEL'").withColumn("dose", F.lit(12.5))
    return planning.zones(_points(t), doses)


@query()
def treatment_missions(t: Bridge) -> DataFrame:
    starts = t.project.select("project_id", F.col("center_lat").alias("start_lat"), F.col("center_lon").alias("start_lon"))
    return planning.missions(treatment_zones(t), starts)


@query()
def launch_times(t: Bridge) -> DataFrame:
    flights = treatment_missions(t).groupBy("project_id", "mission").agg(F.first("minutes").alias("minutes"))
    launches = t.forecast.select(F.col("ts").alias("launch"))
    return planning.best_launch(flights, launches, t.forecast)


@query("""SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity + 15) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wait_min FROM {lineitem}""")
def schedule_cursor(t: Bridge) -> DataFrame:
    stop = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    flights = t.lineitem.select(F.col("l_orderkey").alias("project_id"), stop.alias("mission"), F.col("l_quantity").alias("minutes"), F.timestamp_seconds(F.lit(0)).alias("launch"))
    found = planning.schedule(flights)
    return found.select(F.col("project_id").alias("l_orderkey"), F.col("mission.l_linenumber").alias("l_linenumber"), (F.unix_micros("start") / 60_000_000).alias("wait_min"))


@query(f"""WITH p AS (SELECT asset_id, gps_lat AS lat, gps_lon AS lon, project_id, lag(gps_lat) OVER w AS plat, lag(gps_lon) OVER w AS plon FROM {{asset}} WINDOW w AS (PARTITION BY project_id ORDER BY flight_date, asset_id)),
  d AS (SELECT project_id, {_HAVERSINE} AS m FROM (SELECT project_id, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS s FROM p)) SELECT project_id, sum(CAST(round(coalesce(m, 0) * 1000) AS BIGINT))::BIGINT AS route_mm FROM d GROUP BY project_id""")
def route_lengths(t: Bridge) -> DataFrame:
    legs = planning.route_legs(t.asset, ("project_id",), ("flight_date", "asset_id"), "gps_lat", "gps_lon")
    return legs.select("project_id", F.round(F.col("leg_m") * 1000).cast("long").alias("mm")).groupBy("project_id").agg(F.sum("mm").alias("route_mm"))


@query("""SELECT detection_id, concat_ws(',', detection_id, class_name, printf('%.8f', lat), printf('%.8f', lon), coalesce(printf('%.1f%%', confidence * 100), '')) AS line FROM {detection} WHERE NOT rejected AND (verified OR user_corrected)""")
def export_lines(t: Bridge) -> DataFrame:
    from ..sinks.export import csv_line

    found = t.detection.where(accepted())
    return found.select("detection_id", csv_line(F.col("detection_id"), F.col("class_name"), text.to_fixed(F.col("lat"), 8), text.to_fixed(F.col("lon"), 8), F.when(F.col("confidence").isNotNull(), F.format_string("%.1f%%", F.col("confidence") * 100))).alias("line"))
