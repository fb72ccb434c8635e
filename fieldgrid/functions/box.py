"""Boxes of pixels: corner boxes are structs (x1, y1, x2, y2), centre boxes structs (x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def corner(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def to_centre(b: Column) -> Column:
    return F.struct(((b.x1 + b.x2) / 2).alias("x"), ((b.y1 + b.y2) / 2).alias("y"), (b.x2 - b.x1).alias("w"), (b.y2 - b.y1).alias("h"))


def to_corner(b: Column) -> Column:
    return corner(b.x - b.w / 2, b.y - b.h / 2, b.x + b.w / 2, b.y + b.h / 2)


def parse_centre(json: Column) -> Column:
    """A centre box of JSON text: {x, y, width, height} around its centre or [x1, y1, x2, y2]; null unless all are numbers and the sides positive."""
    # Each text is parsed once: the values are bound to the variables of a transform.
    parsed = F.struct(F.from_json(json, "x double, y double, width double, height double").alias("o"), F.from_json(json, "array<double>").alias("a"), F.ltrim(json).startswith("[").alias("listed"))
    boxes = F.transform(F.array(parsed), lambda p: F.when(p.listed, F.when(F.size(p.a) == 4, to_centre(corner(p.a[0], p.a[1], p.a[2], p.a[3])))).otherwise(F.struct(p.o.x.alias("x"), p.o.y.alias("y"), p.o.width.alias("w"), p.o.height.alias("h"))))
    return F.get(F.filter(boxes, lambda b: (b.w > 0) & (b.h > 0) & b.x.isNotNull() & b.y.isNotNull()), F.lit(0))


def polygon_box(points: Column) -> Column:
    """The centre box around an array of arrays (x, y); null below two points or without an extent."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.when((F.size(points) >= 2) & (x2 > x1) & (y2 > y1), to_centre(corner(x1, y1, x2, y2)))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b.x2 - b.x1) * F.greatest(F.lit(0.0), b.y2 - b.y1)


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without an overlap."""
    both = intersection(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 where that is 0."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def valid(b: Column) -> Column:
    numbers = [~F.isnan(b[c]) for c in ("x1", "y1", "x2", "y2")]
    return F.coalesce((b.x2 > b.x1) & (b.y2 > b.y1) & numbers[0] & numbers[1] & numbers[2] & numbers[3], F.lit(False))


def normalised(b: Column, width: Column, height: Column) -> Column:
    """Centre box in shares of the image (default 4000 x 3000), each clamped to 0..1."""
    w, h = F.coalesce(F.when(width > 0, width), F.lit(4000)), F.coalesce(F.when(height > 0, height), F.lit(3000))
    fit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.struct(fit((b.x1 + b.x2) / 2 / w).alias("x"), fit((b.y1 + b.y2) / 2 / h).alias("y"), fit((b.x2 - b.x1) / w).alias("w"), fit((b.y2 - b.y1) / h).alias("h"))


def axis_starts(length: Column, tile: int, stride: int) -> Column:
    """First pixels of tiles along a side: every stride, and a last one flush with the end."""
    whole = F.floor(length).cast("int")
    last = whole - tile
    inner = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), lambda s: s < last)
    return F.when(whole <= 0, F.array().cast("array<int>")).when(last <= 0, F.array(F.lit(0))).otherwise(F.concat(inner, F.array(last)))


def tile_plan(width: Column, height: Column, tile: int = 1536, overlap: int = 512) -> Column:
    """Array of structs (index, x, y, width, height), row by row."""
    stride = max(1, tile - min(max(0, overlap), tile - 1))
    xs, ys = axis_starts(width, tile, stride), axis_starts(height, tile, stride)
    side = lambda length, start: F.least(F.lit(tile), F.floor(length).cast("int") - start)
    one = lambda y, j: F.transform(xs, lambda x, i: F.struct((j * F.size(xs) + i).alias("index"), x.alias("x"), y.alias("y"), side(width, x).alias("width"), side(height, y).alias("height")))
    return F.flatten(F.transform(ys, one))


def fixed_tiles(width: Column, height: Column, tile: int = 2048, overlap: int = 256) -> Column:
    """Array of structs (x, y, width, height): a tile at every step, the last ones of a row or column as small as what is left."""
    step = max(1, tile - overlap)
    starts = lambda side: F.when(side > 0, F.sequence(F.lit(0), side.cast("int") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    side = lambda whole, start: F.least(F.lit(tile), whole.cast("int") - start)
    return F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: F.struct(x.alias("x"), y.alias("y"), side(width, x).alias("width"), side(height, y).alias("height")))))


def should_tile(width: Column, height: Column, enabled: Column, least: int = 2048, tile: int = 1536) -> Column:
    return F.coalesce(enabled & (width > 0) & (height > 0) & (F.greatest(width, height) >= max(least, tile + 1)), F.lit(False))


def from_tile(b: Column, tile_x: Column, tile_y: Column, width: Column, height: Column) -> Column:
    """A tile's box in its image, clipped; null if nothing is left."""
    x = lambda v: F.greatest(F.lit(0.0), F.least(width.cast("double"), v + tile_x))
    y = lambda v: F.greatest(F.lit(0.0), F.least(height.cast("double"), v + tile_y))
    moved = corner(x(b.x1), y(b.y1), x(b.x2), y(b.y2))
    return F.when(valid(b) & (moved.x2 > moved.x1) & (moved.y2 > moved.y1), moved)


def undo_letterbox(b: Column, scale: Column, pad_x: Column, pad_y: Column) -> Column:
    """A centre box of a padded and scaled image in the original."""
    return F.struct(((b.x - pad_x) / scale).alias("x"), ((b.y - pad_y) / scale).alias("y"), (b.w / scale).alias("w"), (b.h / scale).alias("h"))


def recentre(b: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The corner box moved to a centre, and back inside the image."""
    w, h = b.x2 - b.x1, b.y2 - b.y1
    left = F.greatest(F.lit(0.0), F.least(width - w, x - w / 2))
    top = F.greatest(F.lit(0.0), F.least(height - h, y - h / 2))
    return corner(left, top, left + w, top + h)


def scale_boxes(boxes: Column, source_w: Column, source_h: Column, target_w: Column, target_h: Column, most: int = 10) -> Column:
    """The first boxes of an array of corner boxes in an image of another size: rounded, clamped, without those that lose their extent. Without valid source sizes they are taken as they are."""
    scaled = F.coalesce((source_w > 0) & (source_h > 0), F.lit(False))
    whole = lambda v: F.floor(v + 0.5).cast("double")
    x = lambda v: F.greatest(F.lit(0.0), F.least(target_w.cast("double"), whole(F.when(scaled, v / source_w * target_w).otherwise(v))))
    y = lambda v: F.greatest(F.lit(0.0), F.least(target_h.cast("double"), whole(F.when(scaled, v / source_h * target_h).otherwise(v))))
    moved = F.transform(F.slice(boxes, 1, most), lambda b: corner(x(b.x1), y(b.y1), x(b.x2), y(b.y2)))
    return F.filter(moved, lambda b: (b.x2 > b.x1) & (b.y2 > b.y1))
