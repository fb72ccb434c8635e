"""Masks of objects: run lengths, boxes and simplified outlines, in Arrow batches.

A mask is binary, a byte a pixel (0 or not) by rows, with its width and height. Spark deals masks out; a kernel looks at the runs of many masks together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Share of an outline's length by which it may be simplified, and least area of an outline in square pixels.
TOLERANCE, LEAST_AREA = 0.02, 100.0
#: Steps to the eight neighbours (x, y), counter-clockwise on the screen from the right.
AROUND = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))
#: Bytes of masks that a kernel holds at once, beside one batch of its input.
CHUNK = 4 << 20
SHAPE = "box struct<x1: int, y1: int, x2: int, y2: int>, pixels long, runs array<int>, outline array<struct<x: int, y: int>>, area double, cx double, cy double"


def run_lengths(mask: np.ndarray) -> np.ndarray:
    """Runs of set pixels, read by rows as one line: first pixel (counted from 1) and length by turns."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.ravel() != 0, [0]]).astype(np.int8)))
    edges = edges.reshape(-1, 2)
    return np.stack([edges[:, 0] + 1, edges[:, 1] - edges[:, 0]], 1).ravel()


def from_runs(runs: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mask of run lengths; what lies outside the image is cut off."""
    change = np.zeros(height * width + 1, np.int64)
    pairs = np.asarray(runs, np.int64).reshape(-1, 2)
    np.add.at(change, np.clip(pairs[:, 0] - 1, 0, height * width), 1)
    np.add.at(change, np.clip(pairs[:, 0] - 1 + pairs[:, 1], 0, height * width), -1)
    return (np.cumsum(change)[:-1] > 0).reshape(height, width)


def labelled(mask: np.ndarray) -> np.ndarray:
    """The number, from 1, of each pixel's object (pixels that touch by sides or corners), by first pixels; 0 where none is.

    Runs of rows are linked to those that they touch in the next row, and the least number spreads along the links.
    """
    height, width = mask.shape
    line = np.pad(mask != 0, ((0, 0), (0, 1))).ravel()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], line, [0]]).astype(np.int8))).reshape(-1, 2)
    start, stop = edges[:, 0], edges[:, 1]
    label = _linked(start, stop, np.full(len(start), width + 1))
    out = np.zeros(height * (width + 1), np.int64)
    names = np.unique(label, return_inverse=True)[1] + 1
    out[line] = np.repeat(names, stop - start)
    return out.reshape(height, width + 1)[:, :width]


def border(mask: np.ndarray) -> np.ndarray:
    """Rows (x, y) of the pixels along the outer border of a mask's one object, counter-clockwise from its first pixel.

    The walk keeps the background at one side: at each pixel it turns on from where it came until it meets a pixel of the object, and it
    ends when it is about to leave the first pixel as it left it first.
    """
    height, width = mask.shape
    inside = np.pad(mask != 0, 1).ravel().tolist()
    wide = width + 2
    steps = [y * wide + x for x, y in AROUND]
    first = int(np.flatnonzero(mask.ravel())[0])
    at = start = (first // width + 1) * wide + first % width + 1
    # The first pixel has nothing to its left and above, so the walk begins with a clockwise look from the left.
    came = next((d for d in (4, 3, 2, 1, 0, 7, 6, 5) if inside[start + steps[d]]), None)
    out = [start]
    if came is not None:
        last = start + steps[came]
        while True:
            d = came
            for _ in range(8):
                d = (d + 1) & 7
                if inside[at + steps[d]]:
                    break
            ahead = at + steps[d]
            if ahead == start and at == last:
                break
            out.append(ahead)
            at, came = ahead, (d + 4) & 7
    flat = np.array(out)
    return np.stack([flat % wide - 1, flat // wide - 1], 1)


def corners(ring: np.ndarray) -> np.ndarray:
    """The points of a closed walk where its direction changes."""
    ahead = np.roll(ring, -1, axis=0) - ring
    return ring[(ahead != np.roll(ahead, 1, axis=0)).any(1)] if len(ring) > 2 else ring


def twice_area(ring: np.ndarray) -> int:
    x, y = ring[:, 0], ring[:, 1]
    return abs(int((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()))


def length(ring: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(ring, -1, axis=0) - ring).T).sum())


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """The points of a closed ring without those that lie within tolerance of the chords between the others.

    Two far points split the ring; a part keeps its farthest point if that lies farther off its chord, and is split there.
    """
    n = len(ring)
    far = lambda i: int(((ring - ring[i]) ** 2).sum(1).argmax())
    a = far(0)
    b = far(a)
    if ((ring[a] - ring[b]) ** 2).sum() <= tolerance**2:
        return ring[[a]]
    a, b = min(a, b), max(a, b)
    kept, parts = {a, b}, [(a, b), (b, a + n)]
    while parts:
        i, j = parts.pop()
        if j - i < 2:
            continue
        p, q = ring[i % n].astype(float), ring[j % n].astype(float)
        between = ring[np.arange(i + 1, j) % n] - p
        chord = q - p
        off = np.abs(between[:, 0] * chord[1] - between[:, 1] * chord[0]) / np.hypot(*chord)
        k = int(off.argmax())
        if off[k] > tolerance:
            kept.add((i + 1 + k) % n)
            parts += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[sorted(kept)]


def outline(mask: np.ndarray, tolerance: float = TOLERANCE, least_area: float = LEAST_AREA) -> np.ndarray | None:
    """The simplified outer outline of the object with the largest outline, through middles of pixels; None below least_area or three points.

    Of equally large ones the first in reading order counts.
    """
    found = Runs.of_bytes(np.ascontiguousarray(mask != 0).view(np.uint8).ravel(), np.array([0, mask.size]), *(np.array([n]) for n in mask.shape[::-1]))
    owner, at, rings = found.outlines(tolerance, least_area)
    return rings[0] + at[0] if len(owner) else None


class Runs:
    """Masks of a batch as their runs of set pixels, each read by rows as one line: owner is a run's mask, start its first pixel (from 0), stop the one after its last. Width and height are the masks'."""

    def __init__(self, owner: np.ndarray, start: np.ndarray, stop: np.ndarray, width: np.ndarray, height: np.ndarray):
        self.owner, self.start, self.stop, self.width, self.height = owner, start, stop, width, height

    @classmethod
    def of_bytes(cls, raw: np.ndarray, ends: np.ndarray, width: np.ndarray, height: np.ndarray) -> Runs:
        """Of bytes, between ends a mask's."""
        low, high = int(ends[0]), int(ends[-1])
        words = (high - low) // 8
        # Masks are mostly empty: eight bytes are looked at together first.
        filled = np.flatnonzero(raw[low : low + 8 * words].view(np.uint64))
        places = np.concatenate([(filled[:, None] * 8 + np.arange(8)).ravel(), np.arange(8 * words, high - low)]) + low
        places = places[raw[places] != 0]
        owner = np.searchsorted(ends, places, side="right") - 1
        ahead = np.flatnonzero((np.diff(places) != 1) | (np.diff(owner) != 0)) + 1
        first, last = np.append(0, ahead)[: len(ahead) + bool(len(places))], np.append(ahead, len(places))[: len(ahead) + bool(len(places))] - 1
        own = owner[first]
        return cls(own, places[first] - ends[own], places[last] + 1 - ends[own], width, height)

    @classmethod
    def joined(cls, owner: np.ndarray, start: np.ndarray, stop: np.ndarray, width: np.ndarray, height: np.ndarray) -> Runs:
        """Of runs in any order that may meet; what lies outside a mask is cut off."""
        size = (width * height).astype(np.int64)
        base = np.cumsum(size + 1) - (size + 1)  # masks don't touch
        limit = size[owner]
        at = np.concatenate([np.clip(start, 0, limit) + base[owner], np.clip(stop, 0, limit) + base[owner]])
        order = np.argsort(at, kind="stable")
        at = at[order]
        depth = np.cumsum(np.where(order < len(start), 1, -1))
        settled = np.append(np.flatnonzero(np.diff(at)), len(at) - 1) if len(at) else np.zeros(0, np.int64)
        at, inside = at[settled], depth[settled] > 0
        edges = at[np.flatnonzero(inside != np.append(False, inside[:-1]))].reshape(-1, 2)
        own = np.searchsorted(base, edges[:, 0], side="right") - 1
        return cls(own, edges[:, 0] - base[own], edges[:, 1] - base[own], width, height)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs cut at the ends of rows: owner, y, x, and the x after the last."""
        wide = self.width[self.owner]
        y, last = self.start // wide, (self.stop - 1) // wide
        many = last - y + 1
        of = np.repeat(np.arange(len(y)), many)
        ys = y[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        wide = wide[of]
        return self.owner[of], ys, np.maximum(self.start[of] - ys * wide, 0), np.minimum(self.stop[of] - ys * wide, wide)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """The masks that aren't empty, and their first and last columns and rows (x1, y1, x2, y2)."""
        owner, y, x, end = self.rows()
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if not len(first):
            return first, np.zeros((0, 4), np.int64)
        return owner[first], np.stack([np.minimum.reduceat(x, first), np.minimum.reduceat(y, first), np.maximum.reduceat(end, first) - 1, np.maximum.reduceat(y, first)], 1)

    def outlines(self, tolerance: float, least_area: float) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """The masks that have an outline (see `outline`), and of each the first column and row of its object and the outline's points from there."""
        owner, y, x, end = self.rows()
        step = self.width + 1
        size = (self.height + 2) * step
        line = (np.cumsum(size) - size)[owner] + y * step[owner]
        label = _linked(line + x, line + end, step[owner])
        names, thing = np.unique(label, return_inverse=True)  # by their first run, so in reading order
        order = np.argsort(thing, kind="stable")
        thing, own, y, x, end = (c[order] for c in (thing, owner, y, x, end))
        first = np.flatnonzero(np.diff(thing, prepend=-1))
        if not len(first):
            return [], [], []
        low = np.stack([np.minimum.reduceat(x, first), y[first]], 1)
        high = np.stack([np.maximum.reduceat(end, first) - 1, np.maximum.reduceat(y, first)], 1)
        bound = 2 * (high - low).prod(1)
        shape = np.stack([y - low[thing, 1], x - low[thing, 0], end - low[thing, 0]], 1).astype(np.int32)
        stop = np.append(first[1:], len(thing))
        best: dict[int, tuple[int, int, _Outline]] = {}
        tried = np.flatnonzero(bound >= 2 * least_area)
        tried = tried[np.lexsort((tried, -bound[tried], own[first[tried]]))]
        for i, mask, most, a, b in zip(tried.tolist(), own[first[tried]].tolist(), bound[tried].tolist(), first[tried].tolist(), stop[tried].tolist(), strict=True):
            old = best.get(mask)
            if old is not None and most < old[0]:
                continue
            found = _outline_of(shape[a:b])
            if found.area >= 2 * least_area and (old is None or found.area > old[0] or (found.area == old[0] and i < old[1])):
                best[mask] = found.area, i, found
        rings = [(mask, low[i], ring) for mask, (_, i, found) in best.items() if len(ring := found.simplified(tolerance)) >= 3]
        return [list(c) for c in zip(*rings, strict=True)] if rings else ([], [], [])


def _linked(start: np.ndarray, stop: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The least run of each run's object: runs (sorted, on one line) are linked to those that they touch a row, `step` pixels, ahead, and the least number spreads along the links."""
    # Of the next row, runs that end at or behind the start and begin at or before the end.
    low, high = np.searchsorted(stop, start + step), np.searchsorted(start, stop + step, side="right")
    count = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(start)), count)
    lower = np.arange(len(upper)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    label = np.arange(len(start))
    while len(upper):
        least = np.minimum(label[upper], label[lower])
        new = label.copy()
        for side in (upper, lower, label[upper], label[lower]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


class _Outline:
    """The border's corners of an object, twice their area, and their simplifications."""

    def __init__(self, runs: np.ndarray):
        mask = np.zeros((int(runs[:, 0].max()) + 1, int(runs[:, 2].max())), bool)
        for y, x, end in runs.tolist():
            mask[y, x:end] = True
        self.ring = corners(border(mask))
        self.area = twice_area(self.ring)
        self._simple: dict[float, np.ndarray] = {}

    def simplified(self, tolerance: float) -> np.ndarray:
        if tolerance not in self._simple:
            self._simple[tolerance] = simplified(self.ring, tolerance * length(self.ring))
        return self._simple[tolerance]


#: Outlines of small objects by their runs, since many objects have the same shape: bytes of runs at most, and how many are kept.
SHAPE_BYTES, SHAPES_KEPT = 1024, 1 << 14
_seen: dict[bytes, _Outline] = {}


def _outline_of(runs: np.ndarray) -> _Outline:
    """The outline of an object of runs (y, x, the x after the last) from its own first column and row."""
    name = runs.tobytes() if runs.nbytes <= SHAPE_BYTES else None
    found = _seen.get(name) if name is not None else None
    if found is None:
        found = _Outline(runs)
        if name is not None:
            if len(_seen) >= SHAPES_KEPT:
                _seen.clear()
            _seen[name] = found
    return found


def runs_of(column: pa.Array, width: np.ndarray, height: np.ndarray) -> Runs:
    """The runs of a batch's masks: bytes, boxes to be drawn, or run lengths. Width and height are 0 for those that don't count."""
    good = width > 0
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        found = Runs.of_bytes(np.frombuffer(column.buffers()[2] or b"", np.uint8), ends, width, height)
        kept = good[found.owner]
        return Runs(found.owner[kept], found.start[kept], found.stop[kept], width, height)
    owner = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    items = column.flatten()
    if not pa.types.is_struct(items.type):
        pairs = items.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2)
        owner, start, size = owner[::2], pairs[:, 0] - 1, pairs[:, 1]
        kept = good[owner]
        return Runs.joined(owner[kept], start[kept], start[kept] + size[kept], width, height)
    sides = pc.struct_field(items, "x1"), pc.struct_field(items, "y1"), pc.struct_field(items, "x2"), pc.struct_field(items, "y2")
    known = good[owner] & np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in sides])
    owner = owner[known]
    x1, y1, x2, y2 = (np.maximum(0, c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[known]) for c in sides)
    x1, x2, y2 = np.minimum(x1, width[owner]), np.minimum(x2, width[owner]), np.minimum(y2, height[owner])
    many = np.where(x2 > x1, np.maximum(0, y2 - y1), 0)
    of = np.repeat(np.arange(len(owner)), many)
    row = (y1[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * width[owner[of]]
    return Runs.joined(owner[of], row + x1[of], row + x2[of], width, height)


def _listed(values: pa.Array, owner: np.ndarray, count: np.ndarray, good: np.ndarray) -> pa.Array:
    """Lists of values, as many as each row of owner has, for the good rows, and nulls."""
    sizes = np.zeros(len(good), np.int64)
    sizes[owner] = count
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~good, False)), values)


def shapes(df: DataFrame, key: str = "id", mask: str = "mask", width: str = "width", height: str = "height", tolerance: float = TOLERANCE, least_area: float = LEAST_AREA, outlines: bool = True) -> DataFrame:
    """Rows (key, box, pixels, runs, outline, area, cx, cy) of masks, without the last four unless `outlines`.

    A mask is binary, or what `drawn` or `from_run_lengths` would draw it of, which saves its bytes. box holds the first and last set columns and rows, pixels counts set pixels,
    runs are the run lengths by rows. outline is that of the largest object (see outline), area its area in square pixels, cx and cy the mean of its corners.
    An empty mask has neither box nor outline and no runs; a null mask, or one whose size isn't width x height, has nulls.
    """
    key_type = df.schema[key].dataType.simpleString()
    boxed = df.schema[mask].dataType.simpleString().startswith("array<struct")
    names = ["key", "box", "pixels", "runs", "outline", "area", "cx", "cy"][: 8 if outlines else 4]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        data = b.column(1)
        w, h = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
        good = (w > 0) & (h > 0)
        if not boxed:  # boxes that are null draw nothing
            good &= data.is_valid().to_numpy(zero_copy_only=False)
        if pa.types.is_binary(data.type) or pa.types.is_large_binary(data.type):
            good &= pc.binary_length(data).fill_null(0).to_numpy(zero_copy_only=False) == w * h
        found = runs_of(data, np.where(good, w, 0), np.where(good, h, 0))
        owner, ends = found.boxes()
        n = len(good)
        box = np.zeros((n, 4), np.int32)
        box[owner] = ends
        empty = np.ones(n, bool)
        empty[owner] = False
        struct = pa.StructArray.from_arrays([pa.array(c) for c in box.T.copy()], ["x1", "y1", "x2", "y2"], mask=pa.array(empty))
        pixels = np.bincount(found.owner, found.stop - found.start, n).astype(np.int64)
        runs = pa.array(np.stack([found.start + 1, found.stop - found.start], 1).ravel().astype(np.int32))
        columns = [b.column(0), struct, pa.array(pixels, mask=~good), _listed(runs, np.arange(n), 2 * np.bincount(found.owner, minlength=n), good)]
        if outlines:
            owner, at, rings = found.outlines(tolerance, least_area)
            owner, many = np.array(owner, np.int64), np.array([len(r) for r in rings], np.int64)
            points = np.concatenate(rings) + np.repeat(np.stack(at), many, axis=0) if len(rings) else np.zeros((0, 2), np.int64)
            has = np.zeros(n, bool)
            has[owner] = True
            first = np.cumsum(many) - many
            values = np.zeros((3, n))
            if len(rings):
                values[0, owner] = [twice_area(r) / 2 for r in rings]
                values[1:, owner] = (np.add.reduceat(points, first) / many[:, None]).T
            order = np.argsort(np.repeat(owner, many), kind="stable")
            listed = pa.StructArray.from_arrays([pa.array(points[order, i].astype(np.int32)) for i in (0, 1)], ["x", "y"])
            columns += [_listed(listed, owner, many, has), *(pa.array(v, mask=~has) for v in values)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            yield one(b)

    picked = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{mask}`").alias("mask"), F.col(f"`{width}`").cast("int").alias("w"), F.col(f"`{height}`").cast("int").alias("h"))
    kinds = SHAPE if outlines else SHAPE[: SHAPE.index(", outline")]
    return picked.mapInArrow(run, f"key {key_type}, {kinds}").withColumnRenamed("key", key)


def chunked(batches: Iterator[pd.Series], rows: int, one: Callable[[object], bytes | None]) -> Iterator[pd.Series]:
    """The bytes of each value, in pieces of at most so many rows."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield pd.Series([one(v) for v in b.iloc[i : i + rows]], dtype=object)


def _filled(column: Column, width: int, height: int, one: Callable[[object], bytes | None]) -> Column:
    """A mask of each value, made and handed on in chunks: a mask is many times its value, so a batch of values must not become a batch of masks."""
    rows = max(1, CHUNK // max(1, width * height))

    @F.pandas_udf("binary")
    def fill(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from chunked(batches, rows, one)

    return fill(column)


def drawn(boxes: Column, width: int, height: int) -> Column:
    """The mask of an array of boxes (x1, y1, x2, y2) of whole pixels, each without its right and lower edge; null boxes and the outside don't count."""

    def draw(found) -> bytes:
        mask = np.zeros((height, width), np.uint8)
        for b in found if found is not None else ():
            if b is not None:
                mask[max(0, b["y1"]) : max(0, b["y2"]), max(0, b["x1"]) : max(0, b["x2"])] = 1
        return mask.tobytes()

    return _filled(boxes, width, height, draw)


def from_run_lengths(runs: Column, width: int, height: int) -> Column:
    """The mask of run lengths as `shapes` gives them; null stays null."""
    return _filled(runs, width, height, lambda r: None if r is None else from_runs(r, height, width).astype(np.uint8).tobytes())
