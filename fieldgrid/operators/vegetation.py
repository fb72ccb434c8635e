"""Plants in images: candidates behind a gate of green pixels, boxes moved to the plant, masks of one plant made one.

Candidates of an image meet its pixels once; a kernel sees some hundred images, and looks at equally large boxes of all of them together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.pixels import Boxes, alike, ring_shares
from .geometry import Rings

#: Fixed value: a median of green shares that calls for a look.
ALARM = 0.3
#: Images that a kernel looks at together.
IMAGES = 512
CANDIDATE = "id long, confidence double, x1 double, y1 double, x2 double, y2 double"


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def recentred(boxes: np.ndarray, centres: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The boxes (n, 4), in whole pixels, moved to have their middles at places (n, 2) as far as the images' sizes (n, 2) allow."""
    sides = np.minimum(size, np.maximum(1, _half_up(boxes[:, 2:] - boxes[:, :2])))
    low = np.maximum(0, np.minimum(size - sides, _half_up(centres - sides / 2)))
    return np.concatenate([low, low + sides], 1)


def _by_image(candidates: DataFrame, images: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows (key, pixels, width, height, rows): an image with its candidates, in the order of their ids. Pixels are never broadcast, whatever their size is taken to be."""
    one = candidates.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    pictures = images.select(key, "pixels", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    return one.join(pictures.hint("merge"), key).select(F.col(key).alias("key"), "pixels", "width", "height", "rows")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of batches (key, pixels, width, height, rows), by IMAGES: the keys, bytes, place in them, width and height of each row's image, and the rows.

    Rows of images that are missing or shorter than their size are left out.
    """
    for b in (whole.slice(i, IMAGES) for whole in batches for i in range(0, whole.num_rows, IMAGES)):
        keys, pixels, rows = b.column(0), b.column(1), b.column(4)
        width, height = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
        wide = np.int64 if pa.types.is_large_binary(pixels.type) else np.int32
        ends = np.frombuffer(pixels.buffers()[1], wide)[pixels.offset : pixels.offset + len(pixels) + 1].astype(np.int64)
        raw = np.frombuffer(pixels.buffers()[2] or b"", np.uint8)
        readable = pixels.is_valid().to_numpy(zero_copy_only=False) & (width > 0) & (height > 0) & (np.diff(ends) >= width * height * 3)
        owner = np.repeat(np.arange(len(keys)), pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False))
        good = np.flatnonzero(readable[owner])
        owner = owner[good]
        yield keys.take(pa.array(owner)), owner, raw, ends[:-1][owner], width[owner], height[owner], rows.flatten().take(pa.array(good))


def _number(column: pa.Array) -> np.ndarray:
    """Doubles of a column; null is no number."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def green_shares(candidates: DataFrame, images: DataFrame, paint: Callable[[pa.Array], pa.Array] | None = None, key: str = "asset_id") -> DataFrame:
    """Rows (key, shares): of each image with candidates the array of (id, green) of their boxes' green shares, in the order of ids; null for a null image and for a box outside it.

    images (key, pixels, width, height) are as gate_candidates takes them, or pixels is what `paint` makes them of, a slice of images at a time, so that the bytes don't leave the kernel.
    """
    kind = candidates.schema[key].dataType.simpleString()
    ids = candidates.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, IMAGES) for whole in batches for i in range(0, whole.num_rows, IMAGES)):
            pixels = paint(b.column(1)) if paint else b.column(1)
            width, height = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            wide = np.int64 if pa.types.is_large_binary(pixels.type) else np.int32
            ends = np.frombuffer(pixels.buffers()[1], wide)[pixels.offset : pixels.offset + len(pixels) + 1].astype(np.int64)
            raw = np.frombuffer(pixels.buffers()[2] or b"", np.uint8)
            there = pixels.is_valid().to_numpy(zero_copy_only=False)
            if (np.diff(ends)[there] < (width * height * 3)[there]).any():
                raise ValueError("an image is shorter than its size")
            many = pc.list_value_length(b.column(4)).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(many)), many)
            id_, *sides = b.column(4).flatten().flatten()
            boxes = np.stack([_number(c) for c in sides], 1)
            boxes[~there[owner]] = np.nan
            found = Boxes(raw, ends[:-1][owner], width[owner], height[owner], boxes)
            green = pa.array(found.shares(), mask=found.many[:, 0] == 0)
            offsets = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([id_, green], ["id", "green"]))], names=["key", "shares"])

    found = _by_image(candidates, images, ["id", "x1", "y1", "x2", "y2"], key)
    return found.mapInArrow(run, f"key {kind}, shares array<struct<id: {ids}, green: double>>").withColumnRenamed("key", key)


def gate_candidates(candidates: DataFrame, images: DataFrame, threshold: float, key: str = "asset_id") -> DataFrame:
    """Rows (key, id, confidence, x1, y1, x2, y2, px, py, green, moved) of the candidates whose box is green by `threshold` or more.

    images (key, pixels, width, height) are raw: red, green and blue by rows; key is unique. A box with a patch of green moves its middle there and
    px, py is the patch's middle; without one it stays, and px, py is its own. Candidates of images that are missing or shorter than their
    size go, and a box with a side that is null or no number has no green.
    """
    kind = candidates.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, raw, base, width, height, rows in _slices(batches):
            ids, confidence, *sides = rows.flatten()
            ids, confidence = ids.cast(pa.int64()), confidence.cast(pa.float64())
            boxes = np.stack([_number(c) for c in sides], 1)
            green = Boxes(raw, base, width, height, boxes).shares()
            at = np.flatnonzero(green >= threshold)
            size = np.stack([width, height], 1)[at]
            boxes = boxes[at]
            centres = Boxes(raw, base[at], width[at], height[at], boxes).centres()
            moved = ~np.isnan(centres[:, 0])
            put = np.where(moved[:, None], recentred(boxes, centres, size), boxes)
            middle = np.where(moved[:, None], centres, (boxes[:, :2] + boxes[:, 2:]) / 2)
            picked = pa.array(at)
            doubles = [pa.array(c) for c in (*put.T, *middle.T, green[at])]
            yield pa.RecordBatch.from_arrays([keys.take(picked), ids.take(picked), confidence.take(picked), *doubles, pa.array(moved)], names=["key", "id", "confidence", "x1", "y1", "x2", "y2", "px", "py", "green", "moved"])

    found = _by_image(candidates, images, ["id", "confidence", "x1", "y1", "x2", "y2"], key)
    return found.mapInArrow(run, f"key {kind}, {CANDIDATE}, px double, py double, green double, moved boolean").withColumnRenamed("key", key)


def clean_masks(masks: DataFrame, images: DataFrame, threshold: float, iou: float = 0.5, inside: float = 0.7, key: str = "asset_id") -> DataFrame:
    """Rows (key, id, confidence, green) of the masks (key, id, confidence, ring of pixels x, y) that are green by `threshold` and cover no better mask of their image.

    Masks go by confidence (null: 0), then id; one that overlaps a kept one by `iou` of the union or by `inside` of the smaller, as sampled, goes. Rings of fewer
    than three points, or with a point that is null or no number, are never green.
    """
    kind = masks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, owner, raw, base, width, height, rows in _slices(batches):
            ids, confidence, rings = rows.flatten()
            ids, confidence = ids.cast(pa.int64()), confidence.cast(pa.float64())
            points = np.stack([_number(c) for c in rings.flatten().flatten()], 1)
            many = pc.list_value_length(rings).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(many) - many
            shapes = Rings(points, first, many)
            green = np.zeros(len(many))
            usable = np.flatnonzero((many >= 3) & shapes.known)
            for part in alike(many[usable], cost=many[usable]):
                own = usable[part]
                green[own] = ring_shares(raw, base[own], width[own], height[own], shapes.stack(own))
            good = np.flatnonzero(green >= threshold)
            best = np.nan_to_num(_number(confidence)[good])
            order = good[np.lexsort((ids.to_numpy(zero_copy_only=False)[good], -best, owner[good]))]
            picked = pa.array(order[_uncovered(shapes, owner[order], order, iou, inside)])
            yield pa.RecordBatch.from_arrays([keys.take(picked), ids.take(picked), confidence.take(picked), pa.array(green).take(picked)], names=["key", "id", "confidence", "green"])

    found = _by_image(masks, images, ["id", "confidence", "ring"], key)
    return found.mapInArrow(run, f"key {kind}, id long, confidence double, green double").withColumnRenamed("key", key)


def _uncovered(shapes: Rings, owner: np.ndarray, rings: np.ndarray, iou: float, inside: float) -> np.ndarray:
    """Which of the rings, sorted by their image and then best first, cover no kept one before them in their image.

    Images go side by side: a round looks at the next ring of each image and at the kept ones before it.
    """
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(start, len(owner)))
    kept, many = np.zeros(len(owner), bool), np.zeros(len(start), np.int64)
    taken = np.zeros(len(owner), np.int64)  # from an image's start on, the places of its kept rings
    for turn in range(count.max(initial=0)):
        image = np.flatnonzero(count > turn)
        now = start[image] + turn
        met = np.repeat(np.arange(len(image)), many[image])
        step = np.arange(len(met)) - np.repeat(np.cumsum(many[image]) - many[image], many[image])
        both, most = shapes.overlaps(rings[now[met]], rings[taken[start[image][met] + step]])
        covered = np.bincount(met, (both >= iou) | (most >= inside), len(image)) > 0
        image, now = image[~covered], now[~covered]
        kept[now] = True
        taken[start[image] + many[image]] = now
        many[image] += 1
    return kept


def green_summary(cleaned: DataFrame, key: str = "asset_id", alarm: float = ALARM) -> DataFrame:
    """Rows (key, masks, p10, median, p90, alarm) of clean_masks: interpolated percentiles of green shares, and whether the median is under `alarm`."""
    p = F.percentile("green", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    found = cleaned.groupBy(key).agg(F.count("*").alias("masks"), p.alias("p"))
    return found.select(key, "masks", *(F.col("p")[i].alias(n) for i, n in enumerate(("p10", "median", "p90"))), (F.col("p")[1] < alarm).alias("alarm"))
