"""Vegetation in images: pixels are arrays of bytes, red, green and blue by rows. Kernels run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

#: Excess green from which a pixel counts as vegetation, and samples along a side at most.
GREEN, SAMPLES = 0.12, 256
#: Samples along a side at most where patches are looked for, and samples that a kernel of many boxes holds at once.
PATCH_SAMPLES, AT_ONCE = 64, 1 << 19


def green_mask(pixels: bytes, width: int, height: int, box: tuple[float, float, float, float], samples: int = SAMPLES) -> np.ndarray:
    """Which of the nearest-sampled pixels of a box are green; empty outside the image."""
    image = np.frombuffer(pixels, np.uint8, width * height * 3).reshape(height, width, 3)
    x1, y1, x2, y2 = max(0, int(np.floor(box[0]))), max(0, int(np.floor(box[1]))), min(width, int(np.ceil(box[2]))), min(height, int(np.ceil(box[3])))
    if x2 <= x1 or y2 <= y1:
        return np.zeros((0, 0), bool)
    xs = x1 + np.floor((np.arange(min(samples, x2 - x1)) + 0.5) * (x2 - x1) / min(samples, x2 - x1)).astype(int)
    ys = y1 + np.floor((np.arange(min(samples, y2 - y1)) + 0.5) * (y2 - y1) / min(samples, y2 - y1)).astype(int)
    red, green, blue = image[ys[:, None], xs[None, :]].transpose(2, 0, 1).astype(float)
    total = red + green + blue
    return np.divide(2 * green - red - blue, total, out=np.zeros(total.shape), where=total > 0) > GREEN


@F.pandas_udf(T.DoubleType())
def green_fraction(pixels: pd.Series, width: pd.Series, height: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """Share of a box's pixels that are green; null for a null image or a box outside it."""
    out = []
    for p, w, h, *b in zip(pixels, width, height, x1, y1, x2, y2, strict=True):
        mask = green_mask(p, int(w), int(h), tuple(b)) if p is not None else np.zeros((0, 0), bool)
        out.append(float(mask.mean()) if mask.size else None)
    return pd.Series(out, dtype="float64")


def patch_centre(pixels: bytes, width: int, height: int, box: tuple[float, float, float, float]) -> tuple[float, float] | None:
    """Middle of the largest patch of green pixels (touching by sides, on a grid of at most 64) of a box; None if it is under three pixels or half a per cent."""
    mask = green_mask(pixels, width, height, box, PATCH_SAMPLES)
    around = np.zeros((mask.shape[0] + 2, mask.shape[1] + 2), np.int64)
    label = around[1:-1, 1:-1]
    label[mask] = np.flatnonzero(mask) + 1
    while mask.any():  # the largest label of each patch spreads over it
        new = label.copy()
        for side in (around[:-2, 1:-1], around[2:, 1:-1], around[1:-1, :-2], around[1:-1, 2:]):
            np.maximum(new, side, out=new)
        new *= mask
        if (new == label).all():
            break
        label[:] = new
    counts = np.bincount(label[label > 0]) if mask.any() else np.zeros(1, int)
    if counts.max() < max(3, 0.005 * mask.size):
        return None
    ys, xs = np.nonzero(label == counts.argmax())
    left, top, right, bottom = max(0, box[0]), max(0, box[1]), min(width, box[2]), min(height, box[3])
    return float(left + (xs.mean() + 0.5) * (right - left) / mask.shape[1]), float(top + (ys.mean() + 0.5) * (bottom - top) / mask.shape[0])


def within_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which places are in a ring, by crossings of a ray to the right."""
    inside = np.zeros(np.broadcast(x, y).shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, 1, axis=0), strict=True):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def ring_share(pixels: bytes, width: int, height: int, ring: np.ndarray, samples: int = SAMPLES) -> float:
    """Share of a ring's sampled pixels that are green; 0 for fewer than three points, and where no sample lies inside."""
    if len(ring) < 3:
        return 0.0
    box = (*np.maximum(0, ring.min(0)), *np.minimum((width, height), ring.max(0)))
    mask = green_mask(pixels, width, height, box, samples)
    if not mask.size:
        return 0.0
    left, top, right, bottom = int(np.floor(box[0])), int(np.floor(box[1])), int(np.ceil(box[2])), int(np.ceil(box[3]))
    ys = top + (np.arange(mask.shape[0]) + 0.5) * (bottom - top) / mask.shape[0]
    xs = left + (np.arange(mask.shape[1]) + 0.5) * (right - left) / mask.shape[1]
    inside = within_ring(xs[None, :], ys[:, None], ring)
    return float(mask[inside].mean()) if inside.any() else 0.0


def alike(*columns: np.ndarray, cost: np.ndarray) -> Iterator[np.ndarray]:
    """The places of rows that agree in columns of whole numbers, in pieces of AT_ONCE of cost, which is the same for rows that agree."""
    order = np.lexsort(columns)
    cuts = np.flatnonzero(np.any([np.diff(c[order]) != 0 for c in columns], axis=0)) + 1
    for part in np.split(order, cuts) if len(order) else ():
        many = max(1, AT_ONCE // max(1, int(cost[part[0]])))
        for i in range(0, len(part), many):
            yield part[i : i + many]


class Boxes:
    """Boxes of many images at once, as green_mask and patch_centre see each: boxes (n, 4), in raw bytes the place of each box's image, and its width and height.

    A box with a side that is no number lies outside its image.
    """

    def __init__(self, raw: np.ndarray, base: np.ndarray, width: np.ndarray, height: np.ndarray, boxes: np.ndarray):
        self.raw, self.base, self.width, self.height, self.boxes = raw, base, width, height, boxes
        known = ~np.isnan(boxes).any(1)
        sides = np.where(known[:, None], boxes, 0.0)
        size = np.stack([width, height], 1)
        self.low = np.clip(np.floor(sides[:, :2]), 0, size).astype(np.int64)
        self.high = np.clip(np.ceil(sides[:, 2:]), 0, size).astype(np.int64)
        self.many = np.where(known[:, None], self.high - self.low, 0)
        self.many[(self.many <= 0).any(1)] = 0

    def alike(self, samples: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """Boxes of equally many samples (places, along x, along y); those outside are left out."""
        inside = np.flatnonzero(self.many[:, 0])
        n = np.minimum(self.many[inside], samples)
        for part in alike(n[:, 0], n[:, 1], cost=n.prod(1)):
            yield inside[part], int(n[part[0], 0]), int(n[part[0], 1])

    def green(self, part: np.ndarray, sw: int, sh: int) -> np.ndarray:
        """green_mask (rows of part, y, x) of boxes of as many samples."""
        xs, ys = (self.low[part, i, None] + np.floor((np.arange(n) + 0.5) * self.many[part, i, None] / n).astype(np.int64) for i, n in ((0, sw), (1, sh)))
        at = self.base[part, None, None] + 3 * (ys[:, :, None] * self.width[part, None, None] + xs[:, None, :])
        red, green, blue = (self.raw[at + i].astype(float) for i in range(3))
        total = red + green + blue
        return np.divide(2 * green - red - blue, total, out=np.zeros(total.shape), where=total > 0) > GREEN

    def shares(self, samples: int = SAMPLES) -> np.ndarray:
        """The green share of each box; 0 outside the image."""
        out = np.zeros(len(self.boxes))
        for part, sw, sh in self.alike(samples):
            out[part] = self.green(part, sw, sh).sum((1, 2)) / (sw * sh)
        return out

    def centres(self) -> np.ndarray:
        """patch_centre (n, 2) of each box, no number where it has none."""
        out = np.full((len(self.boxes), 2), np.nan)
        for part, sw, sh in self.alike(PATCH_SAMPLES):
            mask = self.green(part, sw, sh)
            label, sizes = _patches(mask)
            best, most = sizes.argmax(1), sizes.max(1)
            own = label == best[:, None, None]
            low = np.maximum(0, self.boxes[part, :2])
            high = np.minimum(np.stack([self.width[part], self.height[part]], 1), self.boxes[part, 2:])
            for i, n in ((0, sw), (1, sh)):
                mean = (own.sum(1 + i) * np.arange(n)).sum(1) / np.maximum(1, most)
                out[part, i] = np.where(most < max(3, 0.005 * sw * sh), np.nan, low[:, i] + (mean + 0.5) * (high[:, i] - low[:, i]) / n)
        return out


def _patches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of masks (n, y, x) the patches' labels, each its largest place counted from 1, and the sizes (n, label) of patches."""
    n, high, wide = mask.shape
    around = np.zeros((n, high + 2, wide + 2), np.int16)  # at most PATCH_SAMPLES squared
    label = around[:, 1:-1, 1:-1]
    label[:] = mask * np.arange(1, high * wide + 1, dtype=np.int16).reshape(high, wide)
    open_ = np.flatnonzero(mask.any((1, 2)))
    while len(open_):  # the largest label of each patch spreads over it; masks where nothing moved are done
        now = around[open_]
        new = now[:, 1:-1, 1:-1].copy()
        for side in (now[:, :-2, 1:-1], now[:, 2:, 1:-1], now[:, 1:-1, :-2], now[:, 1:-1, 2:]):
            np.maximum(new, side, out=new)
        new *= mask[open_]
        moved = (new != now[:, 1:-1, 1:-1]).any((1, 2))
        open_ = open_[moved]
        label[open_] = new[moved]
    places = np.arange(n)[:, None, None] * (high * wide + 1) + label
    sizes = np.bincount(places.ravel(), minlength=n * (high * wide + 1)).reshape(n, -1)
    sizes[:, 0] = 0
    return label, sizes


def within_rings(xs: np.ndarray, ys: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """within_ring of many rings (n, points, 2) at the crossings (n, y, x) of xs (n, x) and ys (n, y)."""
    inside = np.zeros((len(rings), ys.shape[1], xs.shape[1]), bool)
    ahead = np.roll(rings, 1, axis=1)
    for i in range(rings.shape[1]):
        (x1, y1), (x2, y2) = rings[:, i, :, None].transpose(1, 0, 2), ahead[:, i, :, None].transpose(1, 0, 2)
        across = (y1 > ys) != (y2 > ys)
        reach = (x2 - x1) * (ys - y1) / np.where(y1 == y2, 1.0, y2 - y1) + x1
        inside ^= across[:, :, None] & (xs[:, None, :] < reach[:, :, None])
    return inside


def ring_shares(raw: np.ndarray, base: np.ndarray, width: np.ndarray, height: np.ndarray, rings: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """ring_share of many rings (n, points, 2) of as many points, three at least."""
    size = np.stack([width, height], 1)
    boxes = np.concatenate([np.maximum(0, rings.min(1)), np.minimum(size, rings.max(1))], 1)
    found, out = Boxes(raw, base, width, height, boxes), np.zeros(len(rings))
    for part, sw, sh in found.alike(samples):
        low, high = np.floor(boxes[part, :2]), np.ceil(boxes[part, 2:])
        xs, ys = (low[:, i, None] + (np.arange(n) + 0.5) * (high - low)[:, i, None] / n for i, n in ((0, sw), (1, sh)))
        inside = within_rings(xs, ys, rings[part])
        green = (found.green(part, sw, sh) & inside).sum((1, 2))
        out[part] = green / np.maximum(1, inside.sum((1, 2)))
    return out


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def green_centre(pixels: pd.Series, width: pd.Series, height: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
    """patch_centre of each row; null for a null image."""
    found = [patch_centre(p, int(w), int(h), tuple(b)) if p is not None else None for p, w, h, *b in zip(pixels, width, height, x1, y1, x2, y2, strict=True)]
    return pd.DataFrame([c or (None, None) for c in found], columns=["x", "y"], dtype="float64")


def green_threshold(median):
    """The gate of candidates from the median green share of examples: none under 0.05, else half of it between 0.05 and 0.4."""
    return F.when(median >= 0.05, F.greatest(F.lit(0.05), F.least(F.lit(0.4), 0.5 * median)))
