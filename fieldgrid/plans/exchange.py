"""Packages and files for other tools over whole tables, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import dataset
from ..sinks import packages, shapefile
from ..sources import readers
from ..sources.bridge import Bridge
from ..sources.shapefiles import shapefiles
from ..storage import scratch
from .registry import query

_CLASS = "regexp_replace(regexp_replace(trim(lower(class_name)), '\\s+', '_', 'g'), '[^a-z0-9_]', '', 'g')"


def _coco(t: Bridge) -> DataFrame:
    images = t.asset.select("asset_id", F.format_string("img-%d.jpg", F.col("asset_id")).alias("file_name"), F.col("image_w").alias("width"), F.col("image_h").alias("height"))
    good = t.detection.where("NOT rejected AND (verified OR user_corrected)")
    labels = good.select("asset_id", F.col("detection_id").alias("id"), dataset.sanitised_class(F.col("class_name")).alias("class"), "x1", "y1", "x2", "y2")
    folder = scratch(t.spark, "coco")
    packages.write_coco(images, labels, folder, ("standard_anodized_tin", "sapling"))
    return packages.read_coco(t.spark, folder)


@query(f"""WITH d AS (SELECT asset_id, detection_id, {_CLASS} AS class, x1, y1, x2, y2 FROM {{detection}} WHERE NOT rejected AND (verified OR user_corrected)),
  i AS (SELECT asset_id, row_number() OVER (ORDER BY 'img-' || asset_id || '.jpg', asset_id) AS image_id FROM (SELECT DISTINCT asset_id FROM d)),
  c AS (SELECT 'standard_anodized_tin' AS class, 0 AS category_id UNION ALL SELECT 'sapling', 1 UNION ALL SELECT class, 1 + row_number() OVER (ORDER BY class) FROM (SELECT DISTINCT class FROM d WHERE class NOT IN ('standard_anodized_tin', 'sapling'))),
  n AS (SELECT image_id, category_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, row_number() OVER (ORDER BY image_id, detection_id, category_id, x1, y1, x2 - x1, y2 - y1) AS id FROM d JOIN i USING (asset_id) JOIN c USING (class))
  SELECT id, image_id, category_id::INTEGER AS category_id, concat_ws(',', x1, y1, w, h) AS bbox, (w * h)::DOUBLE AS area FROM n""")
def coco_annotations(t: Bridge) -> DataFrame:
    a = _coco(t).select(F.explode("annotations").alias("a")).select("a.*")
    return a.select("id", "image_id", "category_id", F.array_join(F.transform("bbox", lambda x: x.cast("long").cast("string")), ",").alias("bbox"), "area")


@query("""WITH i AS (SELECT DISTINCT asset_id FROM {detection} WHERE NOT rejected AND (verified OR user_corrected)), n AS (SELECT 'img-' || asset_id || '.jpg' AS file_name, row_number() OVER (ORDER BY 'img-' || asset_id || '.jpg', asset_id) AS id FROM i)
  SELECT id, file_name, 4000 AS width, 3000 AS height, (id - 1) // 1000 AS part FROM n""")
def coco_images(t: Bridge) -> DataFrame:
    part = F.regexp_extract("path", r"coco-(\d+)\.json", 1).cast("long").alias("part")
    return _coco(t).select(part, F.explode("images").alias("i")).select("i.*", "part")


@query("""WITH d AS (SELECT asset_id, string_agg('{"id":' || detection_id || ',"class_name":"' || class_name || '"}', chr(10) ORDER BY detection_id, '{"id":' || detection_id || ',"class_name":"' || class_name || '"}') AS t, count(*) AS n FROM {detection} GROUP BY asset_id),
  p AS (SELECT asset_id, string_agg('{"id":' || pending_id || ',"status":"' || status || '"}', chr(10) ORDER BY pending_id) AS t, count(*) AS n FROM {pending} GROUP BY asset_id)
  SELECT a.asset_id, coalesce(d.n, 0) AS detections, sha256(coalesce(d.t, '')) AS detections_sha256, coalesce(p.n, 0) AS suggestions, sha256(coalesce(p.t, '')) AS suggestions_sha256,
   sha256('{"asset":{"asset_id":' || a.asset_id || ',"project_id":' || a.project_id || '},"evidence":{"detections":{"count":' || coalesce(d.n, 0) || ',"sha256":"' || sha256(coalesce(d.t, '')) || '","rows":[' || coalesce(replace(d.t, chr(10), ','), '') || ']},"suggestions":{"count":' || coalesce(p.n, 0) || ',"sha256":"' || sha256(coalesce(p.t, '')) || '","rows":[' || coalesce(replace(p.t, chr(10), ','), '') || ']}}}') AS sha256, true AS sound
  FROM {asset} a LEFT JOIN d ON d.asset_id = a.asset_id LEFT JOIN p ON p.asset_id = a.asset_id""")
def evidence_bundles(t: Bridge) -> DataFrame:
    """A bundle of each image, written with its digest into archives and verified by reading both."""
    sources = {"detections": t.detection.select("asset_id", F.col("detection_id").alias("id"), "class_name"), "suggestions": t.pending.select("asset_id", F.col("pending_id").alias("id"), "status")}
    folder = scratch(t.spark, "bundles")
    packages.write_archives(packages.bundle_files(packages.bundles(t.asset.select("asset_id", "project_id"), sources)), folder)
    found = packages.verified(readers.archived(t.spark, folder))
    part = "struct<count: bigint, sha256: string>"
    read = F.from_json("document", f"asset struct<asset_id: bigint>, evidence struct<detections: {part}, suggestions: {part}>")
    rows = found.select("sound", F.sha2("document", 256).alias("sha256"), read.alias("r"))
    return rows.select("r.asset.asset_id", *(F.col(f"r.evidence.{s}.{c}").alias(s if c == "count" else f"{s}_sha256") for s in sources for c in ("count", "sha256")), "sha256", "sound")


@query("""SELECT detection_id::VARCHAR AS "ID", class_name AS "CLASS", CAST(floor(coalesce(confidence, 0) * 100 + 0.5E0) AS BIGINT)::VARCHAR AS "CONFIDENCE", 'AI' AS "TYPE", 'img-' || asset_id || '.jpg' AS "ASSET", name AS "PROJECT", strftime(created_at, '%Y-%m-%d') AS "CREATED", round(lat, 9) AS lat, round(lon, 9) AS lon FROM {detection} JOIN {project} USING (project_id)
  UNION ALL SELECT annotation_id::VARCHAR, weed_type, CASE confidence WHEN 'CERTAIN' THEN '100' WHEN 'LIKELY' THEN '75' ELSE '50' END, 'Manual', 'img-' || m.asset_id || '.jpg', name, strftime(m.created_at, '%Y-%m-%d'), round(gps_lat, 9), round(gps_lon, 9) FROM {manual} m JOIN {asset} a ON m.asset_id = a.asset_id JOIN {project} p ON p.project_id = m.project_id""")
def shapefile_read_back(t: Bridge) -> DataFrame:
    """Detections and labels by hand as zipped shapefiles with all fields, read back."""
    shown = lambda key, name, created: (F.col(key).alias("id"), F.col(name).alias("class"), "confidence", F.format_string("img-%d.jpg", F.col("asset_id")).alias("asset"), F.col("name").alias("project"), F.lit("Queensland").alias("location"), F.lit("é").alias("notes"), F.col(created).alias("created"))
    names = t.project.select("project_id", "name")
    at = t.asset.select("asset_id", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))
    a = t.detection.join(names, "project_id").select(*shown("detection_id", "class_name", "created_at"), "lat", "lon")
    b = t.manual.join(names, "project_id").join(at, "asset_id").select(*shown("annotation_id", "weed_type", "created_at"), "lat", "lon")
    folder = scratch(t.spark, "shapes")
    shapefile.write_zipped(shapefile.features(a, b), folder, 20_000).agg(F.sum("n")).collect()
    found = shapefiles(t.spark, folder).where("kind = 'point' AND problem IS NULL")
    point = F.col("parts")[0][0]
    return found.select(*(F.col("attributes")[c].alias(c) for c in ("ID", "CLASS", "CONFIDENCE", "TYPE", "ASSET", "PROJECT", "CREATED")), F.round(point.y, 9).alias("lat"), F.round(point.x, 9).alias("lon"))
