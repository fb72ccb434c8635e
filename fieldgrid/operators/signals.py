"""Labels of three sources as one table of places: the signals of a survey, and the points of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import ring_centroid, valid_coordinate
from ..functions.polygon import valid_ring
from ..functions.text import confidence_of_level, sanitised_class
from .reporting import accepted

_RING = "array<struct<x: double, y: double>>"


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _placed(df: DataFrame, source: str, id_: str, species: Column, confidence: Column, extra: tuple[str, ...]) -> DataFrame:
    """Rows (source, id, species, confidence, lat, lon, ring, extra): the place is the stored one, else the middle of the ring (x longitude, y latitude)."""
    ring = valid_ring(_column(df, "ring", _RING))
    rows = df.select(F.lit(source).alias("source"), F.col(id_).alias("id"), species.alias("species"), confidence.alias("confidence"), "lat", "lon", ring.alias("ring"), *extra)
    good = valid_coordinate(F.col("lat"), F.col("lon"))
    own = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    at = F.filter(F.array(F.when(good, own).otherwise(ring_centroid(F.col("ring")))), lambda p: valid_coordinate(p.y, p.x))
    # As the rows of a generator, places are not computed again by the filters on them.
    return rows.select("source", "id", "species", "confidence", F.inline(at).alias("lon", "lat"), "ring", *extra).select(*rows.columns)


def _share(confidence: Column, default: float = 0.5) -> Column:
    """Held to 0 to 1; the default for none."""
    return F.when(confidence.isNotNull() & ~F.isnan(confidence), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).otherwise(default)


def survey_signals(detections: DataFrame, manual: DataFrame, pending: DataFrame, least: float = 0.0, species: tuple[str, ...] | None = None, extra: tuple[str, ...] = ("survey_id",)) -> DataFrame:
    """All signals of surveys, one row each: accepted detections (detection_id, class_name, ...), verified labels by hand (annotation_id, weed_type, ...) and accepted suggestions (pending_id, weed_type, ...).

    Species are sanitised names; signals without one, below the least confidence, or without a place (stored, or by a `ring` where the source
    has that column) go. A missing confidence is 0.5.
    """
    a = _placed(detections.where(accepted()), "detection", "detection_id", sanitised_class(F.col("class_name")), _share(F.col("confidence")), extra)
    named = F.coalesce(F.when(_column(manual, "class_given", "string") != "", _column(manual, "class_given", "string")), F.col("weed_type"))
    b = _placed(manual.where("verified"), "manual", "annotation_id", sanitised_class(named), confidence_of_level(F.col("confidence")), extra)
    c = _placed(pending.where("status = 'ACCEPTED'"), "suggestion", "pending_id", sanitised_class(F.col("weed_type")), _share(F.col("confidence")), extra)
    found = a.unionByName(b).unionByName(c).where((F.coalesce("species", F.lit("")) != "") & (F.col("confidence") >= least))
    return found if species is None else found.where(F.col("species").isin(*species))


def plan_points(detections: DataFrame, manual: DataFrame, least: float = 0.45, classes: tuple[str, ...] = (), unverified: bool = False, with_detections: bool = True, with_manual: bool = True, extra: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Points to plan for: detections and labels by hand of some classes (all, without any), of the confidence at least, those that are reviewed unless `unverified`.

    Labels by hand without a stored place take the first place of their `ring`.
    """
    good = lambda df, gate, name: df.where((F.lit(unverified) | gate) & (F.col(name).isin(*classes) if classes else F.lit(True)))
    d = good(detections.where(~F.col("rejected")), accepted(), "class_name")
    a = d.where(valid_coordinate(F.col("lat"), F.col("lon"))).select(F.lit("detection").alias("source"), F.col("detection_id").alias("id"), F.trim("class_name").alias("species"), _share(F.col("confidence")).alias("confidence"), "lat", "lon", *extra)
    first = F.get(_column(manual, "ring", _RING), F.lit(0))
    direct = valid_coordinate(F.col("lat"), F.col("lon"))
    at = {"lat": F.when(direct, F.col("lat")).otherwise(first.y), "lon": F.when(direct, F.col("lon")).otherwise(first.x)}
    m = good(manual, F.col("verified"), "weed_type").withColumns(at).where(valid_coordinate(F.col("lat"), F.col("lon")))
    b = m.select(F.lit("annotation").alias("source"), F.col("annotation_id").alias("id"), F.trim("weed_type").alias("species"), confidence_of_level(F.col("confidence")).alias("confidence"), "lat", "lon", *extra)
    none = a.limit(0)
    return (a if with_detections else none).unionByName(b if with_manual else none).where(F.col("confidence") >= least)
