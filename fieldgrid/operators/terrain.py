"""Places on the ground under uneven terrain: the height above ground follows from the terrain of the place that it gives.

A bounded fixpoint for all rows at once: each round projects the open rows, joins the terrain of their places, and closes those whose terrain
settles. Elevations are a table of cells; a round's exchange is that of one equi join, and small tables are broadcast by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.georef import geoid_height, positive, project_pixels
from ..storage import written

#: Rounds for altitudes over the ellipsoid, and metres between two rounds' terrain that count as settled.
ROUNDS, SETTLED_M = 3, 0.5
INPUTS = ("x", "y", "lat", "lon", "camera", "pitch", "roll", "yaw")
HEIGHTS = ("laser", "given", "relative", "takeoff", "absolute", "target")


def elevations(df: DataFrame, lat: Column, lon: Column, grid: DataFrame, cell: float, out: str) -> DataFrame:
    """df with the elevation of the cell that a place lies in; null outside grid (cy, cx, elevation), of which a repeated cell counts by its least."""
    cells = grid.groupBy(F.col("cy").alias("_cy"), F.col("cx").alias("_cx")).agg(F.min("elevation").cast("double").alias(out))
    at = lambda c: F.floor(c / cell).cast("long")
    return df.withColumns({"_cy": at(lat), "_cx": at(lon)}).join(cells, ["_cy", "_cx"], "left").drop("_cy", "_cx")


def _projected(df: DataFrame, height: Column, out: str) -> DataFrame:
    """df with the struct (lat, lon, height) of its pixel seen from a height; null where the ray meets no ground."""
    c = {k: F.col(k) for k in INPUTS}
    df = df.withColumn("_h", height.cast("double"))
    df = project_pixels(df, c["x"], c["y"], c["lat"], c["lon"], c["camera"], c["pitch"], c["roll"], c["yaw"], F.col("_h"), out="_p")
    made = F.struct(F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"), F.col("_h").alias("height"))
    return df.withColumn(out, F.when(F.col("_p").isNotNull(), made)).drop("_h", "_p")


def ground_places(df: DataFrame, grid: DataFrame, cell: float, key: str = "id", default: float | None = 100.0) -> DataFrame:
    """Rows (key, lat, lon, height, method, flags), one for each row of df (key, INPUTS as project_pixels takes them, HEIGHTS).

    The first height that is there counts. laser and given are heights above ground. relative is over the place of take-off: with its elevation
    takeoff the terrain of the first place corrects it once, without it stands (flag takeoff_reference_unknown). absolute is over the ellipsoid: geoid
    and terrain come off, from the terrain under the laser's target (or else under the drone) on, for ROUNDS rounds or until two rounds' terrain is within
    SETTLED_M. Where the grid has no cell, a relative height stands and an absolute one gives way to the default (flag
    estimated_elevation); the default has the flag default_altitude. A ray that meets no ground gives null places.
    """
    kind = F.when(positive(F.col("laser")), "lrf").when(positive(F.col("given")), "provided_height").when(positive(F.col("relative")), "relative_altitude_dem").when(_finite("absolute"), "absolute_altitude_geoid_dem").otherwise("default_altitude")
    base = written(df.select(F.col(key).alias("key"), *INPUTS, *(F.col(c).cast("double").alias(c) for c in HEIGHTS)).withColumn("method", kind), "heights")
    of = lambda *kinds: base.where(F.col("method").isin(*kinds))
    done = [_closed(_projected(of("lrf", "provided_height"), F.when(F.col("method") == "lrf", F.col("laser")).otherwise(F.col("given")), "found"), "method")]
    # Relative altitude: one correction.
    first = _projected(of("relative_altitude_dem"), F.col("relative"), "start")
    first = elevations(first, F.col("start.lat"), F.col("start.lon"), grid, cell, "ground")
    known = _finite("takeoff")
    flag = F.when(~known, "takeoff_reference_unknown").when(F.col("start").isNotNull() & F.col("ground").isNull(), "estimated_elevation")
    height = F.when(known & F.col("start").isNull(), None).when(known & F.col("ground").isNotNull(), F.col("relative") + F.col("takeoff") - F.col("ground")).otherwise(F.col("relative"))
    done.append(_closed(_projected(first, height, "found"), "method", flag))
    # Absolute altitude: rounds.
    state = elevations(of("absolute_altitude_geoid_dem"), F.col("lat"), F.col("lon"), grid, cell, "under")
    none = F.lit(None).cast("struct<lat: double, lon: double, height: double>")
    state = state.withColumn("terrain", F.when(_finite("target"), F.col("target")).otherwise(F.col("under"))).drop("under")
    state = written(state.withColumns({"found": none, "state": F.when(F.col("terrain").isNull(), "unknown").otherwise("open")}), "round")
    closed = [state.where("state <> 'open'")]
    for n in range(ROUNDS):
        now = state.where("state = 'open'")
        if now.isEmpty():
            break
        now = _projected(now.drop("found"), F.col("absolute") - geoid_height(F.col("lat"), F.col("lon")) - F.col("terrain"), "start")
        now = elevations(now, F.col("start.lat"), F.col("start.lon"), grid, cell, "ground")
        now = _projected(now, F.col("absolute") - geoid_height(F.col("start.lat"), F.col("start.lon")) - F.col("ground"), "found")
        ended = F.when(F.col("start").isNull(), "lost").when(F.col("ground").isNull(), "unknown").when(F.col("found").isNull(), "lost").when(F.abs(F.col("ground") - F.col("terrain")) < SETTLED_M, "settled")
        now = now.withColumns({"state": F.coalesce(ended, F.lit("open" if n + 1 < ROUNDS else "settled")), "terrain": F.col("ground")}).drop("start", "ground")
        state = written(now.select(state.columns), "round")
        closed.append(state.where("state <> 'open'"))
    for part in closed:
        done.append(_closed(part.where("state <> 'unknown'"), "method"))
        done.append(_default(part.where("state = 'unknown'").drop("found"), default, "estimated_elevation"))
    done.append(_default(of("default_altitude"), default))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.withColumnRenamed("key", key)


def _finite(name: str) -> Column:
    c = F.col(name)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) & c.isNotNull()


def _closed(df: DataFrame, method: str, *flags: Column | str) -> DataFrame:
    given = F.array_compact(F.array(*(f if isinstance(f, Column) else F.lit(f) for f in flags))) if flags else F.array().cast("array<string>")
    return df.select("key", "found.lat", "found.lon", "found.height", F.col(method).alias("method"), given.alias("flags"))


def _default(df: DataFrame, default: float | None, *flags: str) -> DataFrame:
    df = df.withColumn("method", F.lit("default_altitude"))
    return _closed(_projected(df, F.lit(default).cast("double"), "found"), "method", *flags, "default_altitude")
