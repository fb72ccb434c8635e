"""Unions of cells as shapes: cells dissolve into rings across partitions.

Edges that two cells share cancel in one aggregation; what is left follows itself around, so rings are the components of edges and
their successors. Only the edges of one ring meet in a task, as the row that they become.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import written
from .components import components

#: Of the edges of a cell, counter-clockwise from below: start and end from the cell's lower left, and direction (0 east, 1 north, 2 west, 3 south).
EDGES = ((0, 0, 1, 0, 0), (1, 0, 1, 1, 1), (1, 1, 0, 1, 2), (0, 1, 0, 0, 3))


def runs(cells: DataFrame, key: str) -> DataFrame:
    """cells (key, cy, cx), each once, with `run`: the first cell's column of the row of cells without gaps that each is in."""
    row = Window.partitionBy(key, "cy").orderBy("cx")
    gap = F.col("cx") - F.row_number().over(row)
    return cells.select(key, "cy", "cx", gap.alias("_g")).withColumn("run", F.min("cx").over(Window.partitionBy(key, "cy", "_g"))).drop("_g")


def parts(run_cells: DataFrame, key: str) -> DataFrame:
    """Rows (key, cy, run, part): the runs of each patch of cells that touch by sides; part names its least run, as a struct (k, y, x)."""
    name = lambda y, x: F.struct(F.col(key).alias("k"), F.col(y).alias("y"), F.col(x).alias("x"))
    below = run_cells.select(F.col(key).alias("k"), (F.col("cy") - 1).alias("y"), F.col("cx").alias("x"), F.struct(F.col(key).alias("k"), F.col("cy").alias("y"), F.col("run").alias("x")).alias("b"))
    own = run_cells.select(F.col(key).alias("k"), F.col("cy").alias("y"), F.col("cx").alias("x"), name("cy", "run").alias("a"))
    found = components(own.join(below, ["k", "y", "x"]).select("a", "b").distinct())
    every = run_cells.select(key, "cy", "run").distinct().withColumn("node", name("cy", "run"))
    return every.join(found, "node", "left").select(key, "cy", "run", F.coalesce("root", F.col("node")).alias("part"))


def dissolved(cells: DataFrame, key: str) -> DataFrame:
    """Rows (key, part, ring array<struct x, y>, area, edges) of cells (key, cy, cx): the rings around their union.

    A ring runs along cell borders, in cell numbers, with the union to its left and without corners on straight lines; it isn't closed by a
    repeated corner. area counts cells: positive for outer rings, negative for holes, so the areas of a part sum to its cells. Parts touch by
    sides; where two only touch at a corner, or a hole touches one, rings part there. edges is the length in cell sides. Repeated cells count once, nulls don't.
    """
    once = cells.select(key, "cy", "cx").dropna().distinct()
    marked = written(runs(once, key), "runs")
    edge = F.array(*(F.struct((F.col("cx") + a).alias("x"), (F.col("cy") + b).alias("y"), (F.col("cx") + c).alias("ex"), (F.col("cy") + d).alias("ey"), F.lit(way).alias("way")) for a, b, c, d, way in EDGES))
    sides = marked.select(key, "cy", "run", F.explode(edge).alias("e")).select(key, "cy", "run", "e.*")
    # The same side from both cells has one lower end and one axis.
    low = [F.least("x", "ex").alias("lx"), F.least("y", "ey").alias("ly"), (F.col("way") % 2).alias("axis")]
    first = lambda c: F.min(c).alias(c)
    free = sides.groupBy(key, *low).agg(F.count("*").alias("n"), *map(first, ("x", "y", "ex", "ey", "way", "cy", "run"))).where("n = 1")
    edges = written(free.select(key, "x", "y", "ex", "ey", "way", "cy", "run").withColumn("id", F.monotonically_increasing_id()), "sides")
    # At a corner where two patches touch, a ring turns left and so stays at its patch.
    ahead = edges.select(F.col(key).alias("k"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("id").alias("to"), F.col("way").alias("turned"))
    follows = edges.withColumnRenamed(key, "k").join(ahead, ["k", "ex", "ey"]).groupBy("id").agg(F.min(F.struct(F.pmod(F.col("turned") - F.col("way") + 3, F.lit(4)).alias("turn"), "to")).alias("next"))
    follows = written(follows.select("id", F.col("next.to").alias("to")), "follows")
    rings = components(follows, "id", "to").select(F.col("node").alias("id"), F.col("root").alias("ring"))
    rows = edges.join(follows, "id").join(rings, "id").select("ring", "id", "to", "x", "y", "way")

    def chain(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x", "way"]).reset_index(drop=True)
        place = pd.Series(f.index.to_numpy(), f["id"].to_numpy())
        ahead = place.reindex(f["to"].to_numpy()).to_numpy()
        order, at = np.empty(len(f), np.int64), 0
        for i in range(len(f)):
            order[i], at = at, ahead[at]
        f = f.iloc[order]
        at = f[["x", "y"]].to_numpy()
        x, y = at[:, 0], at[:, 1]
        area = int((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) // 2
        way = f["way"].to_numpy()
        turns = at[way != np.roll(way, 1)]
        return pd.DataFrame([{"id": f["ring"].iloc[0], "ring": [{"x": a, "y": b} for a, b in turns.tolist()], "area": area, "edges": len(f)}])

    chained = rows.groupBy("ring").applyInPandas(chain, "id long, ring array<struct<x: long, y: long>>, area long, edges long")
    of = edges.select("id", key, "cy", "run").join(parts(marked, key), [key, "cy", "run"]).select("id", key, "part")
    return chained.join(of, "id").select(key, "part", "ring", "area", "edges")


def in_degrees(ring: Column, cell: float) -> Column:
    """A ring of cell numbers as a closed ring of structs (x longitude, y latitude)."""
    point = lambda p: F.struct((p.x * cell).alias("x"), (p.y * cell).alias("y"))
    return F.transform(F.concat(ring, F.slice(ring, 1, 1)), point)


def multipolygons(rings: DataFrame, key: str, cell: float) -> DataFrame:
    """Rows (key, geometry, cells): the rings of dissolved as a GeoJSON MultiPolygon; a part is its outer ring (one, since its cells touch by sides) with its holes."""
    shape = rings.select(key, "part", "area", F.transform(in_degrees(F.col("ring"), cell), lambda p: F.array(p.x, p.y)).alias("r"))
    # Outer rings have positive areas and come first.
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((F.col("area") < 0).alias("hole"), "r"))), lambda s: s.r)
    polygons = shape.groupBy(key, "part").agg(ordered.alias("p"), F.sum("area").alias("cells"))
    whole = polygons.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "p"))), lambda s: s.p).alias("coordinates"), F.sum("cells").alias("cells"))
    return whole.select(key, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), "coordinates")).alias("geometry"), "cells")
