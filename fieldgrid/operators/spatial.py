"""Joins by distance, as equi joins of grid buckets with an exact check, and matching one to one."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import RADIUS, haversine
from ..storage import written
from . import walks
from .components import components


def _columns(row: Column, metres: float, dlat: float) -> Column:
    """How many buckets a row of latitude has around the globe: each at least as wide as a pair in it or in the rows beside can be; one near the poles."""
    edge = F.least(F.lit(90.0), (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * dlat)
    shrink = F.cos(F.radians(edge))
    return F.when(shrink <= 10 * metres / RADIUS, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * shrink / dlat))).cast("long")


def near_pairs(left: DataFrame, right: DataFrame, metres: float, keys: tuple[str, ...] = (), id_: str = "id", radius: float = RADIUS) -> DataFrame:
    """Rows (keys, a, b, distance) of places (id, lat, lon, keys) within so many metres that agree in keys, anywhere on the globe.

    Rows of buckets are a little higher than the distance, and each is cut into as many buckets as its latitude allows, around the globe;
    a place meets those of nine buckets, over which the left rows are spread. Null coordinates or keys meet nothing.
    """
    dlat = metres * 1.01 / (math.pi * RADIUS / 180)

    def bucket(lon: Column, many: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * many).cast("long"), many)

    rows = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor(F.col("lat_a") / dlat).cast("long") + i))
    own = left.select(*keys, F.col(id_).alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    spread = own.select("*", rows.alias("cy")).withColumn("many", _columns(F.col("cy"), metres, dlat)).withColumn("at", bucket(F.col("lon_a"), F.col("many")))
    beside = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.pmod(F.col("at") + i, F.col("many"))))
    a = spread.select(*keys, "a", "lat_a", "lon_a", "cy", F.explode(beside).alias("cx"))
    b = right.select(*keys, F.col(id_).alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b")).withColumn("cy", F.floor(F.col("lat_b") / dlat).cast("long"))
    b = b.withColumn("cx", bucket(F.col("lon_b"), _columns(F.col("cy"), metres, dlat)))
    met = a.join(b, [*keys, "cy", "cx"]).withColumn("distance", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), radius))
    return met.where(F.col("distance") <= metres).select(*keys, "a", "b", "distance")


def near_edges(points: DataFrame, metres: float, keys: tuple[str, ...] = (), id_: str = "id", **options) -> DataFrame:
    """near_pairs of a table with itself, each pair once with a < b."""
    return near_pairs(points, points, metres, keys, id_, **options).where("a < b")


#: Metres of a tile's side in distances of a count.
TILE = 4.0


def neighbour_counts(points: DataFrame, metres: float, id_: str = "id", radius: float = RADIUS) -> DataFrame:
    """Rows (id, neighbours): others within so many metres; every row of points stays.

    Places are dealt to tiles, with those around each; a task counts within a tile by strips of latitude, where only places near the
    circle are measured, so no pair is a row.
    """
    dlat = TILE * metres / (math.pi * RADIUS / 180)
    turn = 1.001 * metres / RADIUS
    high = math.degrees(turn)
    many = F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs("cy"), F.abs(F.col("cy") + 1)) * dlat))) / dlat)).cast("long")
    wide = F.when(F.abs("lat") + high < 89.9, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(turn)) / F.cos(F.radians("lat")))))).otherwise(180.0)
    at = lambda shift: F.floor((F.col("lon") + 180 + shift) / 360 * F.col("many")).cast("long")
    good = points.where(~F.isnan("lat") & ~F.isnan("lon")).select(F.col(id_).alias("id"), "lat", "lon").dropna()
    rows = good.select("*", F.explode(F.sequence(F.floor((F.col("lat") - high) / dlat).cast("long"), F.floor((F.col("lat") + high) / dlat).cast("long"))).alias("cy")).withColumn("many", many).withColumn("own", F.pmod(at(F.lit(0.0)), F.col("many")))
    spread = rows.select("id", "lat", "lon", "cy", "own", F.explode(F.array_distinct(F.transform(F.sequence(at(-wide), at(wide)), lambda x: F.pmod(x, F.col("many"))))).alias("cx"))
    dealt = spread.select("cy", "cx", "id", "lat", "lon", ((F.col("cx") == F.col("own")) & (F.floor(F.col("lat") / dlat).cast("long") == F.col("cy"))).alias("own"))

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        own = f["own"].to_numpy()
        number = pd.factorize(f["id"])[0]
        n = walks.counts(f["lat"].to_numpy(), f["lon"].to_numpy(), number, own, metres, radius)
        return pd.DataFrame({"id": f["id"][own], "n": n})

    kind = points.schema[id_].dataType.simpleString()
    counted = dealt.groupBy("cy", "cx").applyInPandas(kernel, f"id {kind}, n long").groupBy(F.col("id").alias("_of")).agg(F.sum("n").alias("neighbours"))
    return points.select(id_).join(counted, F.col(id_) == F.col("_of"), "left").select(id_, F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"))


def least_neighbours(points: DataFrame, metres: float, most: int, id_: str = "id") -> DataFrame:
    """Rows (id, neighbours) of places with ids of their own: the lesser of `most` and how many others are within so many metres.

    Places of a cell are all near each other, so where a cell has more than `most` its places aren't counted; the others meet what is near them.
    """
    placed = _cells(points.select(F.col(id_).alias("id"), "lat", "lon"), CLUSTER_SIDE * metres, ())
    rows = written(placed.withColumn("n", F.count("*").over(Window.partitionBy("cy", "cx"))), "placed")
    found = near_pairs(rows.where(F.col("n") <= most), rows, metres).where("a <> b").groupBy("a").agg(F.least(F.count("*"), F.lit(most)).alias("n"))
    counted = rows.where(F.col("n") > most).select(F.col("id").alias("a"), F.lit(most).cast("long").alias("n")).unionByName(found)
    return points.select(id_).join(counted, F.col(id_) == F.col("a"), "left").select(id_, F.coalesce("n", F.lit(0)).cast("long").alias("neighbours"))


def _cells(points: DataFrame, side: float, keys: tuple[str, ...]) -> DataFrame:
    """points with cells (cy, cx) at most so many metres high and wide, anywhere on the globe. Rows without a place or a key go."""
    dlat = side / (math.pi * RADIUS / 180)
    many = F.greatest(F.lit(1), F.ceil(360 * F.cos(F.radians(F.least(F.abs("cy"), F.abs(F.col("cy") + 1)) * dlat)) / dlat)).cast("long")
    good = points.where(~F.isnan("lat") & ~F.isnan("lon")).dropna(subset=["lat", "lon", *keys]).withColumn("cy", F.floor(F.col("lat") / dlat).cast("long")).withColumn("_many", many)
    return good.withColumn("cx", F.pmod(F.floor((F.col("lon") + 180) / 360 * F.col("_many")).cast("long"), F.col("_many"))).drop("_many")


def _named(placed: DataFrame, keys: tuple[str, ...], id_: str) -> tuple[DataFrame, DataFrame]:
    """The written cells (keys, cy, cx, id, lat, lon), each with its smallest id and that one's place, and the links (a, b) of cells that share an id."""
    cells = written(placed.groupBy(*keys, "cy", "cx").agg(F.min(F.struct(F.col(id_).alias("id"), "lat", "lon")).alias("m")).select(*keys, "cy", "cx", "m.*"), "cells")
    of = placed.select(*keys, "cy", "cx", F.col(id_).alias("own")).join(cells, [*keys, "cy", "cx"]).select("own", "id")
    shared = of.groupBy("own").agg(F.collect_set("id").alias("all")).where(F.size("all") > 1)
    return cells, shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")


def _told(placed: DataFrame, cells: DataFrame, roots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """placed with the `cluster` of their cells' roots."""
    named = cells.join(roots, F.col("id") == F.col("node"), "left").select(*keys, "cy", "cx", F.coalesce("root", "id").alias("cluster"))
    return placed.join(named, [*keys, "cy", "cx"]).drop("cy", "cx")


#: Sides of cells in distances: within one of clusters all places are near each other; islands have few.
CLUSTER_SIDE, ISLAND_SIDE = 0.69, 4.0


def islands(points: DataFrame, metres: float, keys: tuple[str, ...] = (), id_: str = "id", **options) -> DataFrame:
    """The placed points with a `cluster`: groups that no pair within so many metres and no id leaves. They may be wider than components, since cells are linked by their first places alone; the work is the cells', not the pairs'."""
    placed = written(_cells(points, ISLAND_SIDE * metres, keys), "placed")
    cells, shared = _named(placed, keys, id_)
    # Near places are a distance apart, each less than a cell's diagonal from its cell's first.
    linked = near_edges(cells, (1.01 + 2.86 * ISLAND_SIDE) * metres, keys, **options).select("a", "b")
    return _told(placed, cells, components(linked.union(shared)), keys)


def _corners(rows: DataFrame) -> DataFrame:
    """The outermost places (id, lat, lon) of each cell's places (cell, lat, lon) in eight directions."""
    at = F.struct("lat", "lon")
    by = (F.col("lat"), F.col("lon"), F.col("lat") + F.col("lon"), F.col("lat") - F.col("lon"))
    ends = rows.groupBy("cell").agg(*[f(at, c).alias(f"{name}{i}") for i, c in enumerate(by) for name, f in (("l", F.min_by), ("h", F.max_by))])
    return ends.select("cell", F.explode(F.array_distinct(F.array(*[f"{n}{i}" for n in "lh" for i in range(len(by))]))).alias("p")).select("cell", "p.lat", "p.lon")


def _meet(pairs: DataFrame, rows: DataFrame, metres: float, radius: float) -> DataFrame:
    """The pairs of cells (a, b) of which some places (cell, lat, lon) are within so many metres."""
    side = lambda s: rows.select(F.col("cell").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.where(haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), radius) <= metres).select("a", "b").distinct()


def clusters(points: DataFrame, metres: float, keys: tuple[str, ...] = (), id_: str = "id", radius: float = RADIUS) -> DataFrame:
    """Rows (id, cluster): density clusters in which a point and one neighbour suffice, that is components of the graph of near points; points alone are their own.

    Points of a cell are all near each other, so cells are what is linked: by their first and outermost places, and where those leave cells
    apart that may be near, by all places. Work grows with the places, not with their pairs.
    """
    placed = written(_cells(points.select(*keys, F.col(id_).alias("_of"), "lat", "lon"), CLUSTER_SIDE * metres, keys), "placed")
    cells, shared = _named(placed, keys, "_of")
    pairs = written(near_edges(cells, (1.01 + 1.42 * 2 * CLUSTER_SIDE) * metres, keys, radius=radius).select("a", "b", "distance"), "near")
    rows = written(placed.join(cells.select(*keys, "cy", "cx", F.col("id").alias("cell")), [*keys, "cy", "cx"]).select("cell", "lat", "lon"), "rows")
    ends = written(_corners(rows), "corners")
    links = written(pairs.where(F.col("distance") <= metres).select("a", "b").union(_meet(pairs.where(F.col("distance") > metres), ends, metres, radius)).union(shared), "links")
    roots = written(components(links), "roots")
    root = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    apart = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    more = written(_meet(apart, rows, metres, radius), "links")
    if not more.isEmpty():
        roots = components(links.union(more))
    named = _told(placed, cells, roots, keys).select("_of", "cluster").distinct()
    return points.select(id_).join(named, F.col(id_) == F.col("_of"), "left").select(id_, F.coalesce("cluster", F.col(id_)).alias("cluster"))


def grid_clusters(points: DataFrame, keys: tuple[str, ...], cell: str = "cell") -> DataFrame:
    """points with `cluster`: components of cells (cx, cy) that touch by side or corner, within keys; named by their smallest cell number."""
    cells = written(points.select(*keys, "cx", "cy").distinct().withColumn("node", F.xxhash64(*keys, "cx", "cy")), "cells")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    beside = cells.select(*keys, (F.col("cx")).alias("ox"), (F.col("cy")).alias("oy"), F.col("node").alias("a"), steps.alias("s")).select(*keys, (F.col("ox") + F.col("s.i")).alias("cx"), (F.col("oy") + F.col("s.j")).alias("cy"), "a")
    roots = components(beside.join(cells, [*keys, "cx", "cy"]).select("a", F.col("node").alias("b")))
    named = cells.join(roots, "node", "left").select(*keys, "cx", "cy", F.coalesce("root", "node").alias("cluster"))
    return points.join(named, [*keys, "cx", "cy"])


#: Rounds of mutual firsts before what is left is split into components, and rows of a component that one task walks.
ROUNDS, WALKED = 2, 200_000
#: How often the distance of a match is halved for islands of over WALKED places.
HALVES = 6


def _mutual_firsts(rows: DataFrame) -> DataFrame:
    """The rows (a, b, cost) that are the first of both their sides by (cost, a, b)."""
    first = lambda side: rows.groupBy(side).agg(F.min(F.struct("cost", "a", "b")).alias("m")).select("m.*")
    return first("a").join(first("b"), ["cost", "a", "b"]).select("a", "b", "cost")


def _without(rows: DataFrame, taken: DataFrame) -> DataFrame:
    return rows.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti").select("a", "b", "cost")


def _walk(rows: DataFrame) -> DataFrame:
    """The greedy walk of each component (g, a, b, cost), whose rows one task holds."""

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["cost", "na", "nb"], kind="stable")
        used_a, used_b = np.zeros(f["na"].max() + 1, bool), np.zeros(f["nb"].max() + 1, bool)
        kept = np.zeros(len(f), bool)
        for i, (a, b) in enumerate(zip(f["na"].to_numpy(), f["nb"].to_numpy(), strict=True)):
            if not used_a[a] and not used_b[b]:
                kept[i] = used_a[a] = used_b[b] = True
        return f.loc[kept, ["g", "na", "nb"]]

    # Sides are numbered in their order within a component, so ids of any type are compared by Spark.
    place = lambda side: F.dense_rank().over(Window.partitionBy("g").orderBy(side))
    numbered = written(rows.withColumns({"na": place("a"), "nb": place("b")}), "numbered")
    walked = numbered.select("g", "na", "nb", "cost").groupBy("g").applyInPandas(kernel, "g long, na int, nb int")
    return numbered.join(walked, ["g", "na", "nb"]).select("a", "b", "cost")


def match_one_to_one(candidates: DataFrame) -> DataFrame:
    """Of rows (a, b, cost, ...) those that a greedy walk by (cost, a, b) takes, each a and b once.

    Rounds take all rows that are the first of both their sides, and drop the rows that touch them; with a strict order that is
    what the greedy walk takes. After ROUNDS rounds few rows are left: those of small components are walked by a task each, and
    only components of over WALKED rows go on in rounds. Each round is written, so the plan doesn't grow.
    """
    whole = written(candidates, "candidates")
    left, taken = whole.select("a", "b", "cost").distinct(), []
    for _ in range(ROUNDS):
        taken.append(written(_mutual_firsts(left), "matched"))
        left = written(_without(left, taken[-1]), "candidates")
    node = lambda side: F.xxhash64(F.lit(side), F.col(side))
    roots = written(components(left.select(node("a").alias("na"), node("b").alias("nb")), "na", "nb"), "components")
    grouped = written(left.join(roots, node("a") == F.col("node")).select(F.col("root").alias("g"), "a", "b", "cost"), "grouped")
    large = grouped.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > WALKED).select("g")
    taken.append(written(_walk(grouped.join(large, "g", "left_anti")), "matched"))
    left = written(grouped.join(large, "g").select("a", "b", "cost"), "candidates")
    while not left.isEmpty():
        taken.append(written(_mutual_firsts(left), "matched"))
        left = written(_without(left, taken[-1]), "candidates")
    found = taken[0]
    for t in taken[1:]:
        found = found.union(t)
    return whole.join(found, ["a", "b", "cost"]).select(*candidates.columns).dropDuplicates(["a", "b"])


def match_nearest(left: DataFrame, right: DataFrame, metres: float, keys: tuple[str, ...] = (), radius: float = RADIUS, extra: tuple[str, ...] = (), price: Callable | None = None) -> DataFrame:
    """Rows (keys, a, b, cost): of all pairs (id, lat, lon) within so many metres that agree in keys, those that a greedy walk by (cost, a, b) takes, each id once. An island of places is one task's, which makes no pairs.

    The cost is the distance, or what price(one, two) of an island's two sides, with the columns `extra`, makes for walks.nearest_first. By distance, islands
    of over WALKED places are matched within half the distance first, and again, which is how the walk begins; what is free then is sparse, and its islands are small.
    """
    side = lambda df, second: df.select(*keys, "id", "lat", "lon", *extra, F.lit(second).alias("second"))
    both = side(left, False).unionByName(side(right, True)).withColumn("node", F.struct("second", "id"))
    return _matched(both, metres, keys, radius, extra, price, 0 if price else HALVES)


def _matched(both: DataFrame, metres: float, keys: tuple[str, ...], radius: float, extra: tuple[str, ...], price: Callable | None, halves: int) -> DataFrame:
    """match_nearest of both sides (second, node); islands of over WALKED places go by at most so many halves of the distance."""
    grouped = islands(both, metres, keys, "node", radius=radius)
    if halves:
        grouped = written(grouped, "islands")
        large = written(grouped.groupBy(*keys, "cluster").agg(F.count("*").alias("n")).where(F.col("n") > WALKED).select(*keys, "cluster"), "large")
        if not large.isEmpty():
            name = [*keys, "cluster"]
            wide = grouped.join(large, name, "left_semi").select(*both.columns)
            first = written(_matched(wide, metres / 2, keys, radius, extra, price, halves - 1), "matched")
            used = written(first.select(*keys, F.struct(F.lit(False).alias("second"), F.col("a").alias("id")).alias("node")).union(first.select(*keys, F.struct(F.lit(True), F.col("b")))), "used")
            rest = _matched(wide.join(used, [*keys, "node"], "left_anti").select(*both.columns), metres, keys, radius, extra, price, 0)
            return _walked(grouped.join(large, name, "left_anti"), metres, keys, radius, extra, price).unionByName(first).unionByName(rest)
    return _walked(grouped, metres, keys, radius, extra, price)


def _walked(grouped: DataFrame, metres: float, keys: tuple[str, ...], radius: float, extra: tuple[str, ...], price: Callable | None) -> DataFrame:
    """The walk of each island, which one task holds."""
    place = F.dense_rank().over(Window.partitionBy(*keys, "cluster", "second").orderBy("id")) - 1
    rows = written(grouped.select(*keys, "cluster", "second", "id", place.alias("place"), "lat", "lon", *extra), "matching")

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        sides = [f[f["second"] == second] for second in (False, True)]
        taken = walks.nearest_first(*[tuple(x[c].to_numpy() for c in ("place", "lat", "lon")) for x in sides], metres, radius, price(*sides) if price else None)
        ids = [x.drop_duplicates("place").set_index("place")["id"] for x in sides]
        one, two = [t[0] for t in taken], [t[1] for t in taken]
        return pd.DataFrame({"a": ids[0].reindex(one).to_numpy(), "b": ids[1].reindex(two).to_numpy(), "cost": [t[2] for t in taken]} | {k: pd.Series([f[k].iloc[0]] * len(taken), dtype=object) for k in keys})

    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy(*keys, "cluster").applyInPandas(kernel, ", ".join([f"a {kind}, b {kind}, cost double", *kinds])).select(*keys, "a", "b", "cost")


def nearest(points: DataFrame, truth: DataFrame, metres: float, id_: str = "id", **options) -> DataFrame:
    """Rows (a, b, distance): each point's nearest of the truth within so many metres; ties go to the smaller id."""
    return near_pairs(points, truth, metres, (), id_, **options).groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).select("a", "m.b", "m.distance")
