"""Settings that runs are given as text, and what follows from them, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import settings
from ..sources.bridge import Bridge
from .registry import query

#: JSON of an image's number: some values are texts, some out of bounds, some no numbers.
_AUGMENTED = """concat('{"horizontalFlip":', CASE WHEN i % 3 = 0 THEN 'true' WHEN i % 3 = 1 THEN 'false' ELSE '"true"' END, CASE WHEN i % 2 = 0 THEN ',"vertical_flip":true' ELSE '' END, ',"rotation":', CAST(i % 400 - 100 AS STRING),
  CASE WHEN i % 4 = 0 THEN ',"brightness":"130"' WHEN i % 4 = 1 THEN ',"hsv_v":0.25' WHEN i % 4 = 2 THEN ',"brightness":"dim"' ELSE '' END, ',"copiesPerImage":', CAST(i % 30 AS STRING), '.5}')"""


@query(f"""WITH a AS (SELECT asset_id AS i FROM {{asset}}), j AS (SELECT i, {_AUGMENTED.replace("AS STRING", "AS VARCHAR")} AS json FROM a)
  SELECT i AS asset_id, CASE WHEN i % 5 = 0 THEN NULL WHEN i % 5 = 1 THEN NULL ELSE 'strong' END AS preset, CASE i % 3 WHEN 0 THEN true WHEN 1 THEN false END AS horizontal_flip, CASE i % 3 WHEN 0 THEN 0.5E0 WHEN 1 THEN 0.0E0 END AS fliplr, CASE WHEN i % 2 = 0 THEN 0.5E0 END AS flipud,
   CASE WHEN i % 400 > 100 THEN least(180.0E0, i % 400 - 100.0E0) END AS degrees, CASE i % 4 WHEN 0 THEN 100.0E0 WHEN 1 THEN 25.0E0 END AS brightness_pct, CAST(NULL AS DOUBLE) AS saturation_pct, greatest(1, least(10, i % 30 + 1))::INTEGER AS copies_per_image FROM j""")
def told_augmentations(t: Bridge) -> DataFrame:
    i = F.col("i")
    rows = t.asset.select(F.col("asset_id").alias("i"))
    preset = F.when(i % 5 == 0, "none").when(i % 5 == 1, " ").otherwise("strong")
    found = rows.select(i.alias("asset_id"), settings.augmentation(preset, F.expr(_AUGMENTED)).alias("a"))
    return found.select("asset_id", *(f"a.{c}" for c in ("preset", "horizontal_flip", "fliplr", "flipud", "degrees", "brightness_pct", "saturation_pct", "copies_per_image")))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false ELSE true END AS ai, CASE WHEN event_id % 6 = 5 THEN false ELSE true END AS manual, event_id % 5 = 1 AS alone, m AS matcher, m AND event_id % 2 = 0 AS labelling, event_id % 7 = 0 AS training, event_id % 3 = 0 AND user_id % 4 > 0 AS fallback
  FROM (SELECT *, event_id % 3 <> 2 AND event_id % 5 <> 0 AND ((event_id % 2 = 0 AND event_id % 7 < 4) OR event_id % 11 = 0) AS m FROM {events})""")
def told_readiness(t: Bridge) -> DataFrame:
    i = F.col("event_id")
    flags = F.concat(F.lit('{"includeAIDetections":'), F.when(i % 4 == 0, "false").when(i % 4 == 1, '"false"').when(i % 4 == 2, "0").otherwise("true"), F.when(i % 6 == 5, ',"includeManualAnnotations":false').otherwise(""), F.lit("}"))
    ids = F.when(i % 5 == 1, F.array(i)).when(i % 5 == 2, F.array(i, i)).when(i % 5 == 3, F.array().cast("array<bigint>"))
    mod: Column = F.when(i % 3 != 2, True)
    ready = settings.readiness(mod, i % 5 != 0, i % 2 == 0, i % 7 < 4, F.when(i % 11 == 0, True), i % 2 == 0, i % 7 == 0, i % 3 == 0, F.col("user_id") % 4)
    found = t.events.select("event_id", settings.source_flags(flags).alias("s"), settings.one_image_alone(ids).alias("alone"), ready.alias("r"))
    return found.select("event_id", F.col("s.includeAIDetections").alias("ai"), F.col("s.includeManualAnnotations").alias("manual"), "alone", "r.*")


@query("""WITH s AS (SELECT p_partkey AS id, 1 + p_partkey * 7 % 5000 AS w, 1 + p_partkey * 13 % 4000 AS h FROM {part})
  SELECT id, CASE WHEN greatest(w, h) > 2048 THEN floor(w * (2048.0E0 / greatest(w, h)))::INTEGER ELSE w::INTEGER END AS width, CASE WHEN greatest(w, h) > 2048 THEN floor(h * (2048.0E0 / greatest(w, h)))::INTEGER ELSE h::INTEGER END AS height, CASE WHEN greatest(w, h) > 2048 THEN 2048.0E0 / greatest(w, h) ELSE 1.0E0 END AS scale FROM s""")
def fitted_images(t: Bridge) -> DataFrame:
    size = settings.fitted_size(F.expr("1 + p_partkey * 7 % 5000"), F.expr("1 + p_partkey * 13 % 4000"))
    return t.part.select(F.col("p_partkey").alias("id"), size.alias("s")).select("id", "s.*")


@query("""SELECT p_partkey AS id FROM {part} WHERE contains(p_type, 'PROMO') OR contains(p_type, 'promo') OR contains(p_brand, '5')""")
def named_parts(t: Bridge) -> DataFrame:
    return t.part.where(settings.any_contains([F.col("p_type")], ["PROMO", "promo"]) | settings.any_contains([F.col("p_brand")], ["5"])).select(F.col("p_partkey").alias("id"))
