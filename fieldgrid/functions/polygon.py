"""Polygons as arrays of structs (x, y): validity, extents, overlap of extents, other scales."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import box
from .geo import RADIUS, ring_area
from .metadata import let


def valid_ring(ring: Column) -> Column:
    """The ring, or null below three points, with a coordinate that is null or no number, or without an area."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = (F.size(ring) >= 3) & ~F.exists(ring, lambda p: p.isNull() | bad(p.x) | bad(p.y))
    return F.when(good & (2 * ring_area(ring) > 2.220446049250313e-16), ring)


def extent(ring: Column) -> Column:
    """The corner box around a valid ring."""

    def around(good: Column) -> Column:
        xs, ys = F.transform(good, lambda p: p.x), F.transform(good, lambda p: p.y)
        found = box.corner(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
        return let(found, lambda b: F.when(good.isNotNull() & (b.x2 > b.x1) & (b.y2 > b.y1), b))

    return let(valid_ring(ring), around)


def is_rectangle(ring: Column) -> Column:
    """Made from a box: at most five different points, and an area of at least 0.995 of its extent's."""
    around = extent(ring)
    few = F.size(F.array_distinct(ring)) <= 5
    return F.coalesce(around.isNotNull() & few & (ring_area(ring) >= 0.995 * box.area(around)), F.lit(False))


def iou_with_box(ring: Column, other: Column) -> Column:
    """Intersection over union of a ring's extent and a corner box; null where either is none."""
    around = extent(ring)
    both = box.intersection(around, other)
    return F.when(box.valid(other) & around.isNotNull(), F.try_divide(both, box.area(around) + box.area(other) - both))


def rescaled(ring: Column, source_w: Column, source_h: Column, target_w: Column, target_h: Column) -> Column:
    """The ring in an image of another size, in whole pixels within it."""
    fit = lambda v, source, target: F.greatest(F.lit(0.0), F.least(target.cast("double"), F.floor(v / source * target + 0.5).cast("double")))
    return F.transform(ring, lambda p: F.struct(fit(p.x, source_w, target_w).alias("x"), fit(p.y, source_h, target_h).alias("y")))


def geodesic_area(ring: Column, radius: float = 6_378_137.0) -> Column:
    """Square metres of a ring of longitudes (x) and latitudes (y) in degrees on a sphere: the sum of (change of longitude) x (2 + sines of both latitudes) / 2."""
    n = F.size(ring)
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(1))), F.slice(ring, 1, 1))
    part = F.zip_with(ring, turned, lambda a, b: F.radians(b.x - a.x) * (2 + F.sin(F.radians(a.y)) + F.sin(F.radians(b.y))))
    return F.when(n >= 3, F.abs(F.aggregate(part, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))) * radius * radius / 2).otherwise(0.0)


def circle(lat: Column, lon: Column, metres: Column, sides: int = 32) -> Column:
    """A ring of longitudes and latitudes around a place."""
    import math

    turn = [(math.cos(2 * math.pi * i / sides), math.sin(2 * math.pi * i / sides)) for i in range(sides)]
    degree = math.pi * RADIUS / 180
    return F.array(*[F.struct((lon + metres * c / (degree * F.cos(F.radians(lat)))).alias("x"), (lat + metres * s / degree).alias("y")) for c, s in turn])
