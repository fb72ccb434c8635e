"""One object seen several times: duplicates across images, counting by leaders, per-image bias, and overlapping boxes.

Greedy rules look at neighbours only, so they run exactly within islands that no near pair leaves: Spark finds the islands by cells,
and a small kernel walks each in its order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import box
from ..functions.geo import METRES_PROJECTION, RADIUS, RADIUS_COUNTING
from ..storage import written
from . import walks
from .spatial import islands


def _located(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))


def duplicate_groups(detections: DataFrame, metres: float = 1.8, by_class: bool = True, across_images: bool = True) -> DataFrame:
    """Rows (id, leader) of detections (id, asset_id, class_name, confidence, lat, lon, created_at): groups whose members are all within so many metres of each other.

    Seeds go by confidence, then time, then id; a member joins the first seed that it may, of its class and of no image that the
    group has. Metres are held to 0.2 to 6. Rows without a place or without a near row lead themselves. An island of rows is one
    group of a task, which holds its places and no pairs.
    """
    metres = min(6.0, max(0.2, metres))
    keys = ("class_name",) if by_class else ()
    rest = [c for c in detections.columns if c != "id"]
    one = detections.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*")  # rows of one id are one detection
    placed = written(_located(one), "placed")
    alone = Window.partitionBy("cluster")
    order = alone.orderBy(F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(0.0)).desc(), "created_at", "id")
    image = F.dense_rank().over(alone.orderBy("asset_id"))
    members = islands(placed, metres, keys)
    rows = members.select("cluster", "id", "lat", "lon", F.row_number().over(order).alias("place"), image.alias("image"), F.count("*").over(alone).alias("n")).where("n > 1").drop("n")

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place")
        led = walks.cliques(f["lat"].to_numpy(), f["lon"].to_numpy(), f["image"].to_numpy() if across_images else None, metres, RADIUS)
        return pd.DataFrame({"id": f["id"], "leader": f["id"].to_numpy()[led]})

    kind = placed.schema["id"].dataType.simpleString()
    named = rows.groupBy("cluster").applyInPandas(kernel, f"id {kind}, leader {kind}")
    return one.select("id").join(named, "id", "left").select("id", F.coalesce("leader", F.col("id")).alias("leader"))


def representatives(detections: DataFrame, groups: DataFrame, floor: float = 0.05) -> DataFrame:
    """A row for each group: its leader's columns, the mean place weighted by confidence (`floor` at least), the earliest time, members, and their mean weight. Of repeated rows of a leader's id the first in their own order stands."""
    joined = detections.join(groups, "id")
    w = F.greatest(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(floor))
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    sums = joined.groupBy("leader").agg(
        *[(F.sum(F.when(placed, w * F.col(c))) / F.sum(F.when(placed, w))).alias(f"mean_{c}") for c in ("lat", "lon")], F.min("created_at").alias("first_seen"), F.count("*").alias("members"), F.avg(w).alias("mean_weight"),
        F.min(F.when(F.col("id") == F.col("leader"), F.struct(*[c for c in detections.columns if c != "created_at"]))).alias("own"),
    )
    own = [c for c in detections.columns if c != "created_at"]
    return sums.select(*[F.col(f"own.{c}").alias(c) for c in own if c not in ("lat", "lon")], F.coalesce("mean_lat", "own.lat").alias("lat"), F.coalesce("mean_lon", "own.lon").alias("lon"), F.col("first_seen").alias("created_at"), "members", "mean_weight")


def calibration_points(detections: DataFrame, metres: float = 1.8) -> DataFrame:
    """One row for each object of any class (id, asset_id, confidence, lat, lon, created_at): the groups of duplicate_groups across images, with weights of a millionth at least, whose confidence is their mean weight; a row alone keeps its own."""
    rest = [c for c in detections.columns if c != "id"]
    one = detections.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*")  # rows of one id are one detection
    rows = one.withColumn("class_name", F.lit(""))
    found = representatives(rows, duplicate_groups(rows, metres, by_class=False), 1e-6)
    return found.withColumn("confidence", F.when(F.col("members") > 1, F.col("mean_weight")).otherwise(F.col("confidence"))).drop("class_name", "mean_weight")


def leader_counts(detections: DataFrame, metres: float) -> DataFrame:
    """Rows (id, leader) of detections (id, lat, lon, created_at), latest first: each joins the first cluster whose running mean is within so many metres. Rows of one id are one detection.

    A newcomer is less than twice the distance from a cluster's latest member, so islands of that distance don't interact; one is a task's. No distance: each
    alone; places that are null or no numbers don't count.
    """
    one = _located(detections).groupBy("id").agg(F.min(F.struct("lat", "lon", "created_at")).alias("r")).select("id", "r.*")
    if not metres or metres <= 0:
        return one.select("id", F.col("id").alias("leader"))

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["created_at", "id"], ascending=[False, True], kind="stable")
        led = walks.running_means(f["lat"].to_numpy(), f["lon"].to_numpy(), metres, RADIUS_COUNTING)
        return pd.DataFrame({"id": f["id"], "leader": f["id"].to_numpy()[led]})

    found = written(one, "placed")
    near = islands(found, 2.02 * metres).withColumn("n", F.count("*").over(Window.partitionBy("cluster"))).where("n > 1")
    kind = found.schema["id"].dataType.simpleString()
    led = near.select("cluster", "id", "lat", "lon", "created_at").groupBy("cluster").applyInPandas(kernel, f"id {kind}, leader {kind}")
    return found.select("id").join(led, "id", "left").select("id", F.coalesce("leader", F.col("id")).alias("leader"))


def image_bias(detections: DataFrame, metres: float = 1.8, most: float = 1.6, least_points: int = 4, least_anchors: int = 3) -> DataFrame:
    """Rows (asset_id, shift_lat, shift_lon) in degrees: how far an image's detections lie, in the weighted mean, from objects that other images see too.

    Objects are groups of two or more detections; images need least_points detections and least_anchors objects. The mean over all
    images, weighted by objects, is taken off, and a shift is held to `most` metres.
    """
    groups = duplicate_groups(detections, metres)
    w = F.greatest(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(0.05))
    rows = _located(detections).join(groups, "id").withColumn("w", w)
    anchors = rows.groupBy("leader").agg((F.sum(F.col("w") * F.col("lat")) / F.sum("w")).alias("alat"), (F.sum(F.col("w") * F.col("lon")) / F.sum("w")).alias("alon"), F.count("*").alias("n")).where("n >= 2").drop("n")
    off = rows.join(anchors, "leader").select("asset_id", "w", ((F.col("alat") - F.col("lat")) * METRES_PROJECTION).alias("dy"), ((F.col("alon") - F.col("lon")) * METRES_PROJECTION * F.cos(F.radians("lat"))).alias("dx"), "lat")
    enough = rows.groupBy("asset_id").agg(F.count("*").alias("points")).where(F.col("points") >= least_points)
    own = off.groupBy("asset_id").agg((F.sum(F.col("w") * F.col("dx")) / F.sum("w")).alias("dx"), (F.sum(F.col("w") * F.col("dy")) / F.sum("w")).alias("dy"), F.count("*").alias("anchors"), F.avg("lat").alias("lat")).where(F.col("anchors") >= least_anchors).join(enough, "asset_id")
    whole = own.agg((F.sum(F.col("dx") * F.col("anchors")) / F.sum("anchors")).alias("gx"), (F.sum(F.col("dy") * F.col("anchors")) / F.sum("anchors")).alias("gy"))
    centred = own.join(F.broadcast(whole)).withColumns({"dx": F.col("dx") - F.col("gx"), "dy": F.col("dy") - F.col("gy")})  # whole is one row
    shrink = F.least(F.lit(1.0), most / F.greatest(F.hypot("dx", "dy"), F.lit(1e-12)))
    return centred.select("asset_id", (F.col("dy") * shrink / METRES_PROJECTION).alias("shift_lat"), (F.col("dx") * shrink / (METRES_PROJECTION * F.cos(F.radians("lat")))).alias("shift_lon"))


def _overlaps(kind: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def measure(one: np.ndarray, rest: np.ndarray) -> np.ndarray:
        sides = np.minimum(one[2:], rest[:, 2:]) - np.maximum(one[:2], rest[:, :2])
        both = np.clip(sides, 0, None).prod(1)
        a, b = (one[2:] - one[:2]).prod(), (rest[:, 2:] - rest[:, :2]).prod(1)
        whole = a + b - both if kind == "iou" else np.minimum(a, b)
        return np.divide(both, whole, out=np.zeros(len(rest)), where=whole > 0)

    return measure


def suppress(boxes: DataFrame, keys: tuple[str, ...], threshold: float, measure: str = "iou", inclusive: bool = True, order: tuple[str, ...] = ("-confidence", "id", "x1", "y1", "x2", "y2"), budget: int | None = None) -> DataFrame:
    """The boxes (id, keys, confidence, x1, y1, x2, y2) that no box kept before them overlaps by the threshold, within keys (an image, and a class or none).

    measure is 'iou' or 'smaller' (intersection over the smaller area); a budget keeps the first so many. Boxes without an extent or a
    confidence go. Boxes that the order doesn't tell apart go by their other columns, so the result doesn't hang on how rows arrive.
    """
    overlap = _overlaps(measure)
    good = boxes.where("x2 > x1 AND y2 > y1 AND confidence IS NOT NULL AND NOT isnan(confidence)")

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_r")
        b = f[["x1", "y1", "x2", "y2"]].to_numpy(float)
        kept: list[int] = []
        for i in range(len(b)):
            o = overlap(b[i], b[kept]) if kept else np.zeros(0)
            if not ((o >= threshold) if inclusive else (o > threshold)).any():
                kept.append(i)
        return f.iloc[kept].drop(columns="_r")

    told = {o.lstrip("-") for o in order}
    by = [F.col(o[1:]).desc() if o.startswith("-") else F.col(o) for o in order] + [F.col(c) for c in good.columns if c not in told]
    # A box that overlaps no other of its group by the threshold is kept, and drops none: only the others meet the kernel.
    rows = written(good.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))), "boxes")
    shape = box.corner(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    a, b = rows.select(*keys, "_r", shape.alias("p")), rows.select(*keys, F.col("_r").alias("_o"), shape.alias("q"))
    how_much = (box.iou if measure == "iou" else box.overlap_of_smaller)(F.col("p"), F.col("q"))
    touching = a.join(b, list(keys)).where((F.col("_r") != F.col("_o")) & (how_much >= threshold - 1e-9)).select(*keys, "_r").distinct()
    met = rows.join(touching, [*keys, "_r"]).select(*good.columns, "_r").groupBy(*keys).applyInPandas(kernel, good.schema)
    kept_ = rows.join(touching, [*keys, "_r"], "left_anti").select(*good.columns).unionByName(met)
    if budget is None:
        return kept_
    # Whether a box is kept doesn't depend on later ones, so a budget is the beginning of what is kept.
    return kept_.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_n") <= budget).drop("_n")


def best_candidates(boxes: DataFrame, candidates: DataFrame, key: str = "asset_id", least: float = 0.1) -> DataFrame:
    """Rows (box, candidate, iou): for each box (id, asset_id, x1..y2) the candidate of its image that it overlaps most, by at least so much; ties go to the smaller id."""
    four = ("x1", "y1", "x2", "y2")
    a = boxes.select(key, F.col("id").alias("box"), box.corner(*map(F.col, four)).alias("p"))
    b = candidates.select(key, F.col("id").alias("candidate"), box.corner(*map(F.col, four)).alias("q"))
    met = a.join(b, key).select(key, "box", "candidate", box.iou(F.col("p"), F.col("q")).alias("iou")).where(F.col("iou") >= least)
    return met.groupBy(key, "box").agg(F.min(F.struct((-F.col("iou")).alias("minus"), "candidate")).alias("m")).select(key, "box", "m.candidate", (-F.col("m.minus")).alias("iou"))


def merge_refined(candidates: DataFrame, refined: DataFrame, key: str = "asset_id") -> DataFrame:
    """Per image: refined boxes with their best candidate's confidence, and the candidates that no refined box took; all candidates where no refined box has one."""
    best = best_candidates(refined, candidates, key)
    score = candidates.select(key, F.col("id").alias("candidate"), F.col("confidence").alias("score"))
    taken = refined.drop("confidence").join(best.withColumnRenamed("box", "id").drop("iou"), [key, "id"]).join(score, [key, "candidate"]).withColumnRenamed("score", "confidence")
    left = candidates.join(best.select(key, F.col("candidate").alias("id")).distinct(), [key, "id"], "left_anti")
    return taken.select(*candidates.columns).unionByName(left)


def merge_anchors(anchors: DataFrame, found: DataFrame, key: str = "asset_id", least: float = 0.2, same: float = 0.9, most: int = 10) -> DataFrame:
    """Per image: its anchors, then found boxes by confidence that cover or lie in an anchor by so much of the smaller one (any, without anchors) and equal none before, up to `most`.

    Boxes without an image or an extent go. Joins within images find the boxes that meet an anchor and those that equal another; only
    images with such equals are walked in Python.
    """
    iou = _overlaps("iou")
    good = lambda df, is_anchor: df.withColumn("anchor", F.lit(is_anchor)).where(f"x2 > x1 AND y2 > y1 AND {key} IS NOT NULL")
    own, other = good(anchors, True), good(found, False)
    corner = lambda side: box.corner(*[F.col(f"{side}.{c}") for c in ("x1", "y1", "x2", "y2")])
    p, q = corner("p"), corner("q")
    beside = F.col(f"p.{key}") == F.col(f"q.{key}")
    covers = box.intersection(p, q) / F.least(box.area(p), box.area(q)) >= least
    meets = other.alias("p").join(own.alias("q"), beside & covers, "left_semi")
    free = other.join(own.select(key), key, "left_anti").select(*other.columns)
    rows = written(own.unionByName(meets).unionByName(free), "boxes")
    differ = (F.col("p.id") != F.col("q.id")) | F.col("q.anchor")
    equal = rows.where("NOT anchor").alias("p").join(rows.alias("q"), beside & differ & (box.iou(p, q) >= same)).select(F.col(f"p.{key}").alias(key)).distinct()
    order = (F.col("anchor").desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("id"))

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(c=-f["confidence"].fillna(0.0)).sort_values(["anchor", "c", "id"], ascending=[False, True, True], kind="stable").drop(columns="c")
        b = f[["x1", "y1", "x2", "y2"]].to_numpy(float)
        kept = np.flatnonzero(f["anchor"].to_numpy()).tolist()
        for i in range(len(kept), len(f)):
            if len(kept) >= most:
                break
            if not (len(kept) and (iou(b[i], b[kept]) >= same).any()):
                kept.append(i)
        return f.iloc[kept[:most]]

    plain = rows.join(equal, key, "left_anti").select(*rows.columns).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    walked = rows.join(equal, key, "left_semi").select(*rows.columns).groupBy(key).applyInPandas(kernel, rows.schema)
    return plain.unionByName(walked)


def nearest_others(boxes: DataFrame, key: str = "asset_id", count: int = 4, reach: float = 2.0) -> DataFrame:
    """Rows (id, other, distance): for each box the nearest centres of other boxes of its image within so many times its larger side."""
    at = boxes.select(key, "id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("side"))
    pairs = at.alias("p").join(at.alias("q"), F.expr(f"p.{key} = q.{key} AND p.id <> q.id")).select("p.id", F.col("q.id").alias("other"), F.hypot(F.expr("p.cx - q.cx"), F.expr("p.cy - q.cy")).alias("distance"), F.col("p.side").alias("side"))
    near = pairs.where(F.col("distance") <= reach * F.col("side"))
    return near.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))).where(F.col("n") <= count).select("id", "other", "distance")
