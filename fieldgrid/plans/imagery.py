"""Cameras, projections, boxes, polygons and names over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import box, geo, georef, metadata, polygon, settings, text
from ..sources.bridge import Bridge
from ..sources.readers import with_elevation
from .registry import query


def _text(when: Column, value: str, other: Column | None = None) -> Column:
    return F.when(when, F.lit(value)) if other is None else F.when(when, F.lit(value)).otherwise(other)


def _meta() -> Column:
    """Metadata of an image, some of it missing or bad, by its number."""
    i = F.col("asset_id")
    values = {
        "ExifImageWidth": _text(i % 5 == 0, "4100", F.lit("bad")), "PixelXDimension": _text(i % 3 == 0, " 4050 "), "imageHeight": _text(i % 4 == 0, "3100"), "RelativeAltitude": _text(i % 2 == 0, "30.5"), "GPSAltitude": F.lit("250"),
        "GeoAltitudeScale": _text(i % 4 == 0, "1.1", _text(i % 4 == 1, "9")), "CalibratedFocalLength": _text(i % 7 == 0, "3000"), "FocalLengthIn35mmFormat": _text(i % 3 == 1, "24"), "FieldOfView": _text(i % 2 == 1, "70"),
        "GeoFovScale": _text(i % 6 == 0, "1.2"), "GeoYawOffsetDeg": _text(i % 5 == 1, "10", _text(i % 5 == 2, "60")), "CalibratedOpticalCenterX": _text(i % 4 == 2, "1900", _text(i % 4 == 3, "-5")), "LRFTargetDistance": _text(i % 9 == 0, "55.5"),
    }
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


_CAMERA = """SELECT asset_id, greatest(image_w, CASE WHEN asset_id % 5 = 0 THEN 4100 ELSE 0 END, CASE WHEN asset_id % 3 = 0 THEN 4050 ELSE 0 END)::DOUBLE AS width, greatest(image_h, CASE WHEN asset_id % 4 = 0 THEN 3100 ELSE 0 END)::DOUBLE AS height,
  CASE WHEN asset_id % 2 = 0 THEN 30.5E0 WHEN asset_id % 3 <> 0 THEN altitude ELSE 250.0E0 END * CASE WHEN asset_id % 4 = 0 THEN 1.1E0 ELSE 1.0E0 END AS altitude,
  CASE WHEN asset_id % 5 < 2 THEN 84.0E0 WHEN asset_id % 5 = 2 THEN 60.0E0 END AS own, asset_id % 7 = 0 AS calibrated, asset_id % 3 = 1 AS film, CASE WHEN asset_id % 6 = 0 THEN 1.2E0 ELSE 1.0E0 END AS factor,
  gimbal_yaw + CASE WHEN asset_id % 5 = 1 THEN 10 ELSE 0 END AS yaw, CASE WHEN asset_id % 9 = 0 THEN 55.5E0 END AS laser_distance FROM {asset}"""


@query(f"""WITH c AS ({_CAMERA}), f AS (SELECT *, CASE WHEN own = 60 THEN 60.0E0 WHEN calibrated THEN degrees(2 * atan(width / 2 / 3000)) WHEN film THEN degrees(2 * atan(36.0E0 / 48)) WHEN own = 84 THEN 84.0E0 WHEN asset_id % 2 = 1 THEN 70.0E0 ELSE 84.0E0 END AS fov FROM c)
  SELECT asset_id, width, height, round(altitude, 9) AS altitude, round(fov * factor, 9) AS fov, yaw, CASE WHEN asset_id % 4 = 2 THEN 1900.0E0 ELSE width / 2 END AS cx, height / 2 AS cy, laser_distance FROM f""")
def asset_cameras(t: Bridge) -> DataFrame:
    i = F.col("asset_id")
    fov = F.when(i % 5 < 2, 84.0).when(i % 5 == 2, 60.0)
    camera = metadata.asset_camera(F.col("image_w"), F.col("image_h"), F.when(i % 3 != 0, F.col("altitude")), F.col("gimbal_pitch"), F.col("gimbal_roll"), F.col("gimbal_yaw"), fov, _meta())
    found = t.asset.select("asset_id", camera.alias("c"))
    return found.select("asset_id", "c.width", "c.height", F.round("c.altitude", 9).alias("altitude"), F.round("c.fov", 9).alias("fov"), "c.yaw", "c.cx", "c.cy", "c.laser_distance")


@query("""SELECT asset_id, CASE WHEN asset_id % 2 = 0 THEN 30.5E0 ELSE 250.0E0 END AS altitude, -90.0E0 AS pitch, 0.0E0 AS yaw, CASE WHEN asset_id % 2 = 1 THEN 70.0E0 ELSE 84.0E0 END AS fov, CASE WHEN asset_id % 5 = 0 THEN 4100.0E0 END AS width FROM {asset}""")
def exif_cameras(t: Bridge) -> DataFrame:
    found = t.asset.select("asset_id", metadata.exif_camera(_meta()).alias("c"))
    return found.select("asset_id", "c.altitude", "c.pitch", "c.yaw", "c.fov", "c.width")


_PLACES = "SELECT asset_id, -22.0E0 - asset_id % 20 AS lat, 142.0E0 + asset_id % 17 AS lon FROM {asset}"


@query(f"""WITH p AS ({_PLACES}) SELECT asset_id, CASE WHEN lat BETWEEN -30 AND -25 AND lon BETWEEN 150 AND 155 THEN 30.0E0 WHEN lat BETWEEN -35 AND -30 AND lon BETWEEN 150 AND 155 THEN 32.0E0 WHEN lat BETWEEN -40 AND -35 AND lon BETWEEN 145 AND 150 THEN 28.0E0 ELSE 30.0E0 END AS geoid FROM p""")
def geoid_heights(t: Bridge) -> DataFrame:
    return t.spark.sql(_PLACES, asset=t.asset).select("asset_id", georef.geoid_height(F.col("lat"), F.col("lon")).alias("geoid"))


@query(f"""WITH p AS ({_PLACES}) SELECT asset_id, CASE WHEN lat >= -23 AND lon < 150 THEN lon * 2 WHEN lat BETWEEN -28 AND -26 AND lon BETWEEN 152 AND 154 THEN 50.0E0 WHEN lat BETWEEN -35 AND -32 AND lon BETWEEN 150 AND 152 THEN 100.0E0
  WHEN lat BETWEEN -39 AND -36 AND lon BETWEEN 144 AND 146 THEN 150.0E0 WHEN lon BETWEEN 147 AND 153 THEN 300.0E0 WHEN lon < 147 THEN 200.0E0 ELSE 100.0E0 END AS elevation FROM p""")
def place_elevations(t: Bridge) -> DataFrame:
    places = t.spark.sql(_PLACES, asset=t.asset)
    known = places.where("lat >= -23 AND lon < 150").select("lat", "lon", (F.col("lon") * 2).alias("elevation"))
    return with_elevation(places, known).select("asset_id", "elevation")


@query("""WITH h AS (SELECT asset_id, CASE WHEN asset_id % 5 = 0 AND sin(radians(gimbal_pitch)) < -0.05E0 THEN altitude * 1.3E0 * -sin(radians(gimbal_pitch)) END AS laser, CASE WHEN asset_id % 3 = 0 THEN altitude + 1 END AS given, CASE WHEN asset_id % 2 = 0 THEN altitude ELSE -1.0E0 END AS relative, altitude + 20 AS absolute FROM {asset})
  SELECT asset_id, round(CASE WHEN laser > 0 THEN laser WHEN given > 0 THEN given WHEN relative > 0 THEN relative WHEN absolute - 30 - 20 > 0 THEN absolute - 30 - 20 ELSE 100 END, 6) AS height, CASE WHEN laser > 0 THEN 'lrf' WHEN given > 0 THEN 'provided_height' WHEN relative > 0 THEN 'relative_altitude' WHEN absolute - 30 - 20 > 0 THEN 'absolute_altitude' ELSE 'default' END AS method FROM h""")
def cascaded_heights(t: Bridge) -> DataFrame:
    i, a = F.col("asset_id"), F.col("altitude")
    laser = F.when(i % 5 == 0, georef.laser_height(a * 1.3, F.col("gimbal_pitch"), F.col("gimbal_roll"), F.col("gimbal_yaw")))
    found = georef.cascade_height(laser, F.when(i % 3 == 0, a + 1), F.when(i % 2 == 0, a).otherwise(-1.0), a + 20, georef.geoid_height(F.col("gps_lat"), F.col("gps_lon")), F.lit(20.0))
    return t.asset.select("asset_id", found.alias("h")).select("asset_id", F.round("h.height", 6).alias("height"), "h.method")


_RAYS = """c AS (SELECT d.detection_id, a.gps_lat, a.gps_lon, a.altitude, radians(a.gimbal_pitch) p, radians(a.gimbal_yaw) w, a.image_w / (2 * tan(radians(a.camera_fov) / 2)) f, PIXEL, a.image_w / 2.0E0 cx, a.image_h / 2.0E0 cy,
    greatest(250.0E0, 3 * a.altitude * sqrt(pow(tan(radians(a.camera_fov) / 2), 2) + pow(tan(radians(a.camera_fov) / 2) * a.image_h / a.image_w, 2))) AS most FROM (SELECT *, row_number() OVER () AS rid FROM {detection}) d JOIN {asset} a ON d.asset_id = a.asset_id CORNERS),
  r AS (SELECT *, (x - cx) / f tx, (y - cy) / f ty FROM c), v AS (SELECT *, cos(p) + ty * sin(p) AS ahead, sin(p) - ty * cos(p) AS up FROM r), e AS (SELECT *, ahead * sin(w) + tx * cos(w) AS east, ahead * cos(w) - tx * sin(w) AS north FROM v),
  g AS (SELECT *, up < -0.05E0 * sqrt(east * east + north * north + up * up) AND sin(p) < -0.05E0 AS good FROM e),
  o AS (SELECT *, altitude / -up * east AS de, altitude / -up * north AS dn, altitude / -sin(p) * cos(p) * sin(w) AS ce, altitude / -sin(p) * cos(p) * cos(w) AS cn FROM g),
  pl AS (SELECT *, CASE WHEN good THEN CAST(round((gps_lat + dn / 111111.0E0) * 10000000) AS BIGINT) END AS lat_e7, CASE WHEN good THEN CAST(round((gps_lon + de / (111111.0E0 * cos(radians(gps_lat)))) * 10000000) AS BIGINT) END AS lon_e7, sqrt(pow(de - ce, 2) + pow(dn - cn, 2)) AS offset_m FROM o)"""


def _rays(pixel: str, corners: str = "") -> str:
    return _RAYS.replace("PIXEL", pixel).replace("CORNERS", corners)


def _framed(t: Bridge) -> tuple[DataFrame, Column]:
    rows = t.detection.join(t.asset.drop("project_id", "survey_id"), "asset_id")
    none = F.lit(None).cast("double")
    return rows, georef.intrinsics(none, none, none, F.col("image_w"), F.col("image_h"), F.col("camera_fov"))


@query(f"""WITH {_rays("(d.x1 + d.x2) / 2.0E0 x, (d.y1 + d.y2) / 2.0E0 y")} SELECT detection_id, CASE WHEN offset_m <= most THEN lat_e7 END AS lat_e7, CASE WHEN offset_m <= most THEN lon_e7 END AS lon_e7 FROM pl""")
def projected_places(t: Bridge) -> DataFrame:
    rows, camera = _framed(t)
    x, y = georef.normalise_pixel((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("image_w"), F.col("image_h"))
    most = georef.most_offset(F.col("altitude"), F.col("camera_fov"), F.col("image_w"), F.col("image_h"))
    found = georef.project_pixels(rows, x, y, F.col("gps_lat"), F.col("gps_lon"), camera, F.col("gimbal_pitch"), F.col("gimbal_roll"), F.col("gimbal_yaw"), F.col("altitude"), most)
    return found.select("detection_id", *[F.round(F.col(f"geo.{c}") * 10_000_000).cast("long").alias(f"{c}_e7") for c in ("lat", "lon")])


@query(f"""WITH {_rays("d.rid, n, CASE WHEN n IN (1, 2) THEN d.x2 ELSE d.x1 END + 0.0E0 x, CASE WHEN n IN (2, 3) THEN d.y2 ELSE d.y1 END + 0.0E0 y", "CROSS JOIN (VALUES (0), (1), (2), (3)) k(n)")}
  SELECT detection_id, CASE WHEN count(lat_e7) = 4 THEN sum(lat_e7)::BIGINT END AS lats, CASE WHEN count(lat_e7) = 4 THEN sum(lon_e7)::BIGINT END AS lons, CASE WHEN count(lat_e7) = 4 THEN max(lat_e7) FILTER (WHERE n = 0) END AS first_lat FROM pl GROUP BY rid, detection_id""")
def box_polygons(t: Bridge) -> DataFrame:
    rows, camera = _framed(t)
    found = georef.box_polygon(rows, F.col("x1").cast("double"), F.col("y1").cast("double"), (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double"), F.col("gps_lat"), F.col("gps_lon"), camera, F.col("gimbal_pitch"), F.col("gimbal_roll"), F.col("gimbal_yaw"), F.col("altitude"))
    e7 = lambda i, c: F.round(F.col("polygon")[i][c] * 10_000_000).cast("long")
    total = lambda c: e7(0, c) + e7(1, c) + e7(2, c) + e7(3, c)
    return found.select("detection_id", total("lat").alias("lats"), total("lon").alias("lons"), e7(0, "lat").alias("first_lat"))


@query("""WITH s AS (SELECT detection_id, x1 / 4000.0E0 AS x, y1 / 2000.0E0 AS y, x1 FROM {detection}) SELECT detection_id, round(CASE WHEN x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 THEN x * 4000 ELSE greatest(0.0E0, least(4000.0E0, x)) END, 6) AS px, round(CASE WHEN x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 THEN y * 3000 ELSE greatest(0.0E0, least(3000.0E0, y)) END, 6) AS py FROM s""")
def normalised_pixels(t: Bridge) -> DataFrame:
    x, y = georef.normalise_pixel(F.col("x1") / 4000, F.col("y1") / 2000, F.lit(4000), F.lit(3000))
    return t.detection.select("detection_id", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@query("""WITH p AS (SELECT asset_id, gps_lat, gps_lon, altitude, gps_lat + (asset_id % 7) * 0.005E0 AS tlat, gps_lon AS tlon FROM {asset}), s AS (SELECT *, pow(sin(radians(tlat - gps_lat) / 2), 2) AS s FROM p)
  SELECT asset_id, 2 * 6371000.0E0 * atan2(sqrt(s), sqrt(1 - s)) <= greatest(2000.0E0, 8 * altitude + 500) AS plausible, gps_lat + 0 AS lat FROM s""")
def plausible_targets(t: Bridge) -> DataFrame:
    good = georef.plausible_target(F.col("gps_lat"), F.col("gps_lon"), F.col("gps_lat") + (F.col("asset_id") % 7) * 0.005, F.col("gps_lon"), F.col("altitude"))
    return t.asset.select("asset_id", good.alias("plausible"), F.col("gps_lat").alias("lat"))


@query("""SELECT detection_id, CASE detection_id % 5 WHEN 0 THEN x1 + 0.0E0 WHEN 1 THEN (x1 + x2) / 2.0E0 END AS x, CASE detection_id % 5 WHEN 0 THEN y1 + 0.0E0 WHEN 1 THEN (y1 + y2) / 2.0E0 END AS y, CASE WHEN detection_id % 5 < 2 THEN x2 - x1 + 0.0E0 END AS w, CASE WHEN detection_id % 5 < 2 THEN y2 - y1 + 0.0E0 END AS h FROM {detection}""")
def parsed_boxes(t: Bridge) -> DataFrame:
    i, x1, y1, x2, y2 = (F.col(c) for c in ("detection_id", "x1", "y1", "x2", "y2"))
    centred = F.to_json(F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height")))
    listed = lambda *c: F.to_json(F.array(*c))
    json = F.when(i % 5 == 0, centred).when(i % 5 == 1, listed(x1, y1, x2, y2)).when(i % 5 == 2, listed(x2, y1, x1, y2)).when(i % 5 == 3, "oops").otherwise(F.to_json(F.struct(x1.alias("x"))))
    return t.detection.select("detection_id", box.parse_centre(json).alias("b")).select("detection_id", "b.x", "b.y", "b.w", "b.h")


@query("""WITH b AS (SELECT detection_id, x1 % 1536 AS x1, y1 % 1536 AS y1, x1 % 1536 + x2 - x1 AS x2, y1 % 1536 + y2 - y1 AS y2, x1 % 1000 + 1500 AS tx, y1 % 900 + 1500 AS ty FROM {detection}),
  m AS (SELECT detection_id, least(4000, x1 + tx) AS a, least(3000, y1 + ty) AS b, least(4000, x2 + tx) AS c, least(3000, y2 + ty) AS d FROM b)
  SELECT detection_id, CASE WHEN c > a AND d > b THEN a + 0.0E0 END AS x1, CASE WHEN c > a AND d > b THEN b + 0.0E0 END AS y1, CASE WHEN c > a AND d > b THEN c + 0.0E0 END AS x2, CASE WHEN c > a AND d > b THEN d + 0.0E0 END AS y2 FROM m""")
def boxes_from_tiles(t: Bridge) -> DataFrame:
    x, y = F.col("x1") % 1536, F.col("y1") % 1536
    b = box.corner(x, y, x + F.col("x2") - F.col("x1"), y + F.col("y2") - F.col("y1"))
    moved = box.from_tile(b, F.col("x1") % 1000 + 1500, F.col("y1") % 900 + 1500, F.lit(4000), F.lit(3000))
    return t.detection.select("detection_id", moved.alias("m")).select("detection_id", "m.x1", "m.y1", "m.x2", "m.y2")


@query("""SELECT detection_id, round(((x1 + x2) / 2.0E0 - 16) / 0.5E0, 6) AS x, round((x2 - x1) / 0.5E0, 6) AS w, greatest(0.0E0, least(4000.0E0 - (x2 - x1), x1 + 100 - (x2 - x1) / 2.0E0)) AS left_, floor(x1 / 4000.0E0 * 1000 + 0.5E0) AS sx1, greatest(x2, y2) >= 2048 AS tiled FROM {detection}""")
def moved_boxes(t: Bridge) -> DataFrame:
    b = box.corner(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    free = box.undo_letterbox(box.to_centre(b), F.lit(0.5), F.lit(16.0), F.lit(8.0))
    centred = box.recentre(b, F.col("x1") + 100.0, F.col("y1") + 100.0, F.lit(4000.0), F.lit(3000.0))
    scaled = box.scale_boxes(F.array(b), F.lit(4000), F.lit(3000), F.lit(1000), F.lit(750))
    found = t.detection.select("detection_id", free.alias("f"), centred.alias("c"), scaled[0].alias("s"), box.should_tile(F.col("x2"), F.col("y2"), F.lit(True)).alias("tiled"))
    return found.select("detection_id", F.round("f.x", 6).alias("x"), F.round("f.w", 6).alias("w"), F.col("c.x1").alias("left_"), F.col("s.x1").alias("sx1"), "tiled")


def _ring(t: Bridge) -> DataFrame:
    """A triangle, a rectangle, a line, a pentagon or nothing of each box."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    i = F.col("detection_id") % 5
    shapes = {0: (p(x1, y1), p(x2, y1), p(x2, y2)), 1: (p(x1, y1), p(x2, y1), p(x2, y2), p(x1, y2), p(x1, y1)), 2: (p(x1, y1), p(x2, y2), p(x1, y1)), 3: (p(x1, y1), p(x2, y1), p(x2, y2), p((x1 + x2) / 2, y2 + 10), p(x1, y2))}
    ring = F.lit(None).cast("array<struct<x: double, y: double>>")
    for k, v in shapes.items():
        ring = F.when(i == k, F.array(*v)).otherwise(ring)
    return t.detection.select("detection_id", "x1", "y1", "x2", "y2", ring.alias("ring"))


@query("""WITH d AS (SELECT *, detection_id % 5 AS i, (x2 - x1) * (y2 - y1) + 0.0E0 AS a FROM {detection})
  SELECT detection_id, i IN (0, 1, 3) AS valid, CASE WHEN i IN (0, 1) THEN y2 + 0.0E0 WHEN i = 3 THEN y2 + 10.0E0 END AS bottom, i = 1 AS rectangle, round(CASE WHEN i IN (0, 1) THEN 1.0E0 WHEN i = 3 THEN a / ((x2 - x1) * (y2 + 10.0E0 - y1)) END, 9) AS iou, CASE WHEN i IN (0, 1, 2, 3) THEN floor(x1 / 4000.0E0 * 1333 + 0.5E0) END AS scaled_x FROM d""")
def polygon_checks(t: Bridge) -> DataFrame:
    b = box.corner(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    r = F.col("ring")
    return _ring(t).select(
        "detection_id", polygon.valid_ring(r).isNotNull().alias("valid"), polygon.extent(r).y2.alias("bottom"), polygon.is_rectangle(r).alias("rectangle"), F.round(polygon.iou_with_box(r, b), 9).alias("iou"),
        polygon.rescaled(r, F.lit(4000), F.lit(3000), F.lit(1333), F.lit(1000))[0].x.alias("scaled_x"),
    )


@query("""SELECT asset_id, round(abs(radians(0.001E0) * (2 + 2 * sin(radians(gps_lat))) - radians(0.001E0) * (2 + 2 * sin(radians(gps_lat + 0.001E0)))) * 6378137.0E0 * 6378137.0E0 / 2, 3) AS area_m2, round(gps_lon + 0.0005E0, 9) AS cx, round(gps_lat + 0.0005E0, 9) AS cy, asset_id % 2 = 0 AS inside FROM {asset}""")
def ground_rings(t: Bridge) -> DataFrame:
    lat, lon = F.col("gps_lat"), F.col("gps_lon")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(lon, lat), p(lon + 0.001, lat), p(lon + 0.001, lat + 0.001), p(lon, lat + 0.001))
    at = F.when(F.col("asset_id") % 2 == 0, 0.0004).otherwise(0.0015)
    found = t.asset.select("asset_id", ring.alias("r"), (lon + at).alias("x"), (lat + at).alias("y"))
    c = geo.ring_centroid(F.col("r"))
    return found.select("asset_id", F.round(polygon.geodesic_area(F.col("r")), 3).alias("area_m2"), F.round(c.x, 9).alias("cx"), F.round(c.y, 9).alias("cy"), geo.point_in_ring(F.col("x"), F.col("y"), F.col("r")).alias("inside"))


@query("""WITH s AS (SELECT asset_id, altitude AS h, pow(sin(radians(0.001E0) / 2), 2) AS s FROM {asset}) SELECT asset_id, round(degrees(atan(abs(h - 20) / (2 * 6371000.0E0 * atan2(sqrt(s), sqrt(1 - s))))), 6) AS slope FROM s""")
def terrain_slopes(t: Bridge) -> DataFrame:
    slope = geo.slope_degrees(F.col("gps_lat"), F.lit(150.0), F.lit(20.0), F.col("gps_lat") + 0.001, F.lit(150.0), F.col("altitude"))
    return t.asset.select("asset_id", F.round(slope, 6).alias("slope"))


@query("""SELECT asset_id, count(*) AS tiles, max(x) AS last_x, min(w) AS least_w, sum(w * h)::BIGINT AS pixels FROM (SELECT asset_id, x, least(2048, image_w - x) AS w, least(2048, image_h - y) AS h FROM {asset}, (VALUES (0), (1792), (3584)) tx(x), (VALUES (0), (1792)) ty(y)) GROUP BY asset_id""")
def fixed_tile_plans(t: Bridge) -> DataFrame:
    tiles = t.asset.select("asset_id", F.explode(box.fixed_tiles(F.col("image_w"), F.col("image_h"))).alias("t"))
    return tiles.groupBy("asset_id").agg(F.count("*").alias("tiles"), F.max("t.x").alias("last_x"), F.min("t.width").alias("least_w"), F.sum((F.col("t.width") * F.col("t.height")).cast("long")).alias("pixels"))


@query("""SELECT annotation_id, CASE annotation_id % 6 WHEN 0 THEN 0.95E0 WHEN 1 THEN 0.75E0 WHEN 2 THEN 0.5E0 WHEN 3 THEN 0.8E0 WHEN 4 THEN 0.42E0 ELSE 0.5E0 END AS share, concat('date-', strftime(created_at, '%Y-%m-%d')) AS survey, concat('Survey ', strftime(created_at, '%Y-%m-%d')) AS name,
  CASE WHEN annotation_id % 2 = 0 THEN 'oom' ELSE 'inference_error' END AS kind, CASE WHEN annotation_id % 3 = 0 THEN concat('p', annotation_id) END AS project, concat('&lt;', weed_type, ' &amp; &quot;', annotation_id, '&apos;s') AS xml FROM {manual}""")
def told_labels(t: Bridge) -> DataFrame:
    i = F.col("annotation_id")
    told = F.element_at(F.array(*map(F.lit, ("certain ", "LIKELY", "UNCERTAIN", "80", "0.42", "what"))), (i % 6 + 1).cast("int"))
    key = text.survey_key(F.lit(" "), F.col("created_at"))
    kind = text.failure_kind(F.when(i % 2 == 0, "E1").otherwise("E2"), F.when(i % 2 == 0, "CUDA failed").otherwise("bad input"))
    path = F.when(i % 3 == 0, F.concat(F.lit("team/p"), i, F.lit("/x.jpg"))).otherwise("x.jpg")
    xml = text.xml_text(F.concat(F.lit("<"), F.col("weed_type"), F.lit(' & "'), i.cast("string"), F.lit("'s")))
    return t.manual.select("annotation_id", text.parse_confidence(told).alias("share"), key.alias("survey"), text.survey_name(key).alias("name"), kind.alias("kind"), text.project_of_key(path).alias("project"), xml.alias("xml"))


@query("""SELECT asset_id, least(greatest(asset_id % 300 - 20, 1), 200)::INTEGER AS lim, CASE WHEN asset_id % 4 = 0 THEN 0.25E0 ELSE least(1.0E0, (asset_id % 30) / 10.0E0) END AS ratio, CASE asset_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS flag, CASE WHEN asset_id % 5 = 0 THEN 1.8E0 ELSE least(6.0E0, greatest(0.2E0, (asset_id % 80) / 10.0E0)) END AS radius,
  CASE WHEN asset_id % 14 <= 1 THEN 4608 WHEN asset_id % 14 <= 2 THEN 5632 WHEN asset_id % 14 <= 4 THEN 7168 WHEN asset_id % 14 <= 6 THEN 8704 WHEN asset_id % 14 <= 8 THEN 10240 WHEN asset_id % 14 <= 10 THEN 12800 ELSE 4096 + asset_id % 14 END::BIGINT AS mb, ceil(ceil((asset_id % 5000) / 16.0E0) * 0.5E0 * 40 / 60)::BIGINT AS minutes FROM {asset}""")
def told_settings(t: Bridge) -> DataFrame:
    i = F.col("asset_id")
    word = lambda c: c.cast("string")
    ratio = settings.ratio(F.when(i % 4 == 0, "x").otherwise(word((i % 30) / 10)), 0.25)
    flag = settings.boolean(F.when(i % 3 == 0, " TRUE").when(i % 3 == 1, "0").otherwise("maybe"), True)
    radius = settings.radius(F.when(i % 5 == 0, "").otherwise(word((i % 80) / 10)), 1.8)
    return t.asset.select("asset_id", settings.limit(word(i % 300 - 20), 50, 200).alias("lim"), ratio.alias("ratio"), flag.alias("flag"), radius.alias("radius"), settings.gpu_memory(i % 14).mb.alias("mb"), settings.training_minutes(i % 5000, F.lit(40)).cast("long").alias("minutes"))


@query("""SELECT detection_id, CASE detection_id % 3 WHEN 0 THEN lat WHEN 1 THEN lat + 1 END AS lat, CASE detection_id % 3 WHEN 0 THEN lon WHEN 1 THEN lon + 1 END AS lon FROM {detection}""")
def label_centres(t: Bridge) -> DataFrame:
    i, lat, lon = F.col("detection_id") % 3, F.col("lat"), F.col("lon")
    direct = F.to_json(F.struct(lat.alias("centerLat"), lon.alias("centerLon")))
    ring = F.to_json(F.struct(F.lit(500.0).alias("centerLat"), lon.alias("centerLon"), F.struct(F.array(F.array(F.array(lon + 1, lat + 1), F.array(lon, lat))).alias("coordinates")).alias("geometry")))
    found = t.detection.select("detection_id", settings.centre_of_json(F.when(i == 0, direct).when(i == 1, ring).otherwise('{"geometry": 3}')).alias("c"))
    return found.select("detection_id", "c.lat", "c.lon")
