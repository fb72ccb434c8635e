"""SimHash near-duplicates over vantage-point trees.

Fingerprints are 64 bits of a document's word shingles. Distinct fingerprints are dealt to the leaves of a
vantage-point tree over Hamming distance, whose vantage points and radii come from a bounded sample. A fingerprint stays in
one leaf; it also visits those later leaves that its ball overlaps, by the triangle bounds, so every pair within the
radius meets exactly once. Each leaf searches a tree of its own and returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import join_hot, slices, written
from ..operators.components import components
from .words import NOT_BLANK, cut

#: Words of a shingle, bits in which linked fingerprints may differ, seed of the shingle hash.
SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints wanted in a leaf, and those in a leaf's smallest bucket.
LEAF, BUCKET = 2500, 64
#: The dealing tree grows with the table: the sample that sets it has SAMPLE fingerprints, and PER_LEAF for each leaf if that is more. The driver
#: holds it, so there are at most 2 ** LEVELS leaves (8 MB of tree, 64 MB of sample); with more than 2 ** LEVELS * LEAF fingerprints leaves are split into blocks.
SAMPLE, PER_LEAF, LEVELS = 20_000, 16, 19


def bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit: an array (texts, 64). Bytes of sums stand side by side in 64-bit words."""
    out = np.zeros((len(counts), 64), np.int64)
    if not len(hashes):
        return out
    pieces = -(-counts // 255)
    of = np.repeat(np.arange(len(counts)), pieces)
    within = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(counts) - counts, pieces) + within * 255
    ones = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & ones, start)
        lanes = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.zeros((len(counts), 8), np.int64)
        np.add.at(total, of, lanes)
        out[:, bit::8] = total
    return out


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    data, first, length, counts = cut([(t or "").encode() for t in texts], NOT_BLANK)
    raw, ends, digest = data.tobytes(), first + length, xxhash.xxh64_intdigest
    hashes: list[int] = []
    shingles = np.where(counts > shingle, counts - shingle + 1, np.minimum(counts, 1))
    starts_all = np.concatenate([[0], np.cumsum(counts)])
    single = first[1:] - ends[:-1] == 1  # one byte between the words
    single &= data[np.minimum(ends[:-1], len(data) - 1)] == 0x20
    for i, n in enumerate(shingles.tolist()):
        if not n:
            continue
        lo, hi = int(starts_all[i]), int(starts_all[i + 1])
        size = min(shingle, hi - lo)
        if single[lo : hi - 1].all():  # the text itself is its words, joined by one blank each
            hashes += [digest(raw[a:b], seed) for a, b in zip(first[lo : lo + n].tolist(), ends[lo + size - 1 : hi].tolist(), strict=True)]
        else:
            joined = b" ".join(raw[a:b] for a, b in zip(first[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True))
            stops = np.cumsum(length[lo:hi] + 1) - 1
            begins = stops - length[lo:hi]
            hashes += [digest(joined[a:b], seed) for a, b in zip(begins[:n].tolist(), stops[size - 1 :].tolist(), strict=True)]
    sums = bit_counts(np.array(hashes, np.uint64), shingles[shingles > 0])
    full = np.zeros((len(texts), 64), bool)
    full[shingles > 0] = 2 * sums > shingles[shingles > 0, None]
    return np.packbits(full, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """Rows (key, fp long: the fingerprint's bits), one for each row of df; null, empty and blank texts have fingerprint 0. With `hashed` also text_hash, the hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 4 << 20):
            found = pa.array(fingerprints(b.column(1).to_pylist(), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), found, *b.columns[2:]], names=names)

    names = ["key", "fp", *(["text_hash"] if hashed else [])]
    whole = F.col(f"`{text}`").cast("string")
    own = df.select(F.col(f"`{key}`").alias("key"), whole.alias("text"), *([F.xxhash64(whole).alias("text_hash")] if hashed else []))
    kind = df.schema[key].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind}, fp long" + (", text_hash long" if hashed else "")).withColumnRenamed("key", key)


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


class Tree:
    """Vantage points and radii of a complete binary tree, in heap order; the near side of node i is 2i + 1, the far side 2i + 2."""

    def __init__(self, sample: np.ndarray, levels: int, seed: int = 0):
        self.levels = levels
        self.points = np.zeros(2**levels - 1, np.uint64)
        self.radii = np.zeros(2**levels - 1, np.int16)
        rng = np.random.default_rng(seed)

        def grow(node: int, part: np.ndarray) -> None:
            if node >= len(self.points) or not len(part):
                return
            # Of a few candidates, the point that spreads the rest most.
            tries = rng.choice(part, min(8, len(part)), replace=False)
            spread = [distance(part, t).std() for t in tries]
            point = tries[int(np.argmax(spread))]
            far = distance(part, point)
            # Of the radii near the median, the one with the fewest fingerprints whose ball would be cut.
            options = np.arange(np.quantile(far, 0.3), np.quantile(far, 0.7) + 1).astype(np.int16)
            cut_by = [(np.count_nonzero(np.abs(2 * (far - o) - 1) < 2 * RADIUS), abs(np.count_nonzero(far <= o) - len(far) / 2)) for o in options]
            radius = options[min(range(len(options)), key=lambda k: cut_by[k])] if len(options) else np.int16(0)
            self.points[node], self.radii[node] = point, radius
            grow(2 * node + 1, part[far <= radius])
            grow(2 * node + 2, part[far > radius])

        grow(0, sample)

    def deal(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the fingerprint, leaf, at home): its own leaf, and each later leaf with which its ball overlaps."""
        index, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.levels):
            d = distance(fps[index], self.points[node]) - self.radii[node]
            near, far = d <= 0, d > 0
            # A point of the near side lies within the radius, one of the far side beyond it.
            to_near = np.flatnonzero(near | (~home & (d <= radius)))
            to_far = np.flatnonzero(far | (d > -radius))
            index, node, home = (
                np.concatenate([index[to_near], index[to_far]]),
                np.concatenate([2 * node[to_near] + 1, 2 * node[to_far] + 2]),
                np.concatenate([home[to_near], home[to_far] & far[to_far]]),
            )
        return index, node - (2**self.levels - 1), home


def links(fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a leaf: pairs of fingerprints, one of them at home, within the radius.

    The fingerprints at home form a vantage-point tree; all are searched in it together, and a branch is left where the
    triangle bounds leave no fingerprint within the radius.
    """
    fps, take = np.unique(fps, return_index=True)
    home = home[take]
    parent = list(range(len(fps)))
    out: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    stack = [(np.flatnonzero(home), np.arange(len(fps)))]
    while stack:
        part, seekers = stack.pop()
        if not len(part) or not len(seekers):
            continue
        point = part[len(part) // 2]
        d = distance(fps[part], fps[point])
        middle = int(np.median(d))
        if len(part) <= BUCKET or (d <= middle).all():
            for i in range(0, len(seekers), 1024):
                some = seekers[i : i + 1024]
                at, to = np.nonzero(distance(fps[some][:, None], fps[part][None, :]) <= radius)
                for x, y in zip(some[at].tolist(), part[to].tolist(), strict=True):
                    if x != y:
                        join(x, y)
            continue
        e = distance(fps[seekers], fps[point])
        stack.append((part[d <= middle], seekers[e <= middle + radius]))
        stack.append((part[d > middle], seekers[e > middle - radius]))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (a, b) of fingerprints that link all distinct values of fps.fp (long) within the radius: a spanning forest of every leaf.

    Null fingerprints take no part; a table of fewer than two has no rows.
    """
    distinct = written(fps.select("fp").where("fp IS NOT NULL").distinct(), "fingerprints")
    n = distinct.count()
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(n, 1) / LEAF)))))
    wanted = max(SAMPLE, PER_LEAF << levels)
    # A share of the fingerprints, by their hash.
    share = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(np.ceil((1 << 30) * min(1.0, wanted / max(n, 1)))))
    sample = np.sort(share.toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    tree = Tree(sample, levels)
    # How many blocks a leaf's home is split into, by its part of the sample.
    _, leaf, home = tree.deal(sample, -1)
    expected = np.bincount(leaf[home], minlength=2**levels) * (n / max(len(sample), 1))
    blocks = np.maximum(1, np.ceil(expected / (8 * LEAF))).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 5000):
                own = b.column(0).slice(i, 5000).to_numpy().view(np.uint64)
                index, leaf, home = tree.deal(own, radius)
                # Each block holds its part of the home, and all others of the leaf as visitors.
                many = blocks[leaf]
                row = np.repeat(np.arange(len(index)), many)
                block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                fp = own[index[row]]
                at_home = home[row] & (block == (fp % many[row].astype(np.uint64)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(leaf[row]), pa.array(block), pa.array(at_home)], names=["fp", "leaf", "block", "home"])

    def search(table: pa.Table) -> pa.Table:
        a, b = links(table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.mapInArrow(deal, "fp long, leaf long, block long, home boolean")
    return dealt.groupBy("leaf", "block").applyInArrow(search, "a long, b long")


def groups(fps: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """fps (key, fp, ...) with component_id: the smallest key whose fingerprint is reached by links, one row for each row of fps.

    Rows with a null key have their fingerprint's component, which is null if no row of it has a key.
    """
    fps = written(fps, "fingerprints")
    least = fps.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("rows"))
    roots = components(near_links(fps, radius))
    own = least.join(roots, least.fp == roots.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    own = written(own, "roots")
    of_root = own.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(own.join(of_root, "root").select("fp", "rows", "component_id"), "components")
    # Blank texts, or copies of one text, may be most rows.
    return join_hot(fps, found, "fp", "rows").select(*fps.columns, "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of df without those whose group has a smaller key; rows of one key in one group are one document, and rows with a null key go where their group has a key.

    Rows go by key and text, so another row of the same (or null) key stays if its own group has no smaller key.
    """
    found = groups(fingerprint(df, key, text, shingle, hashed=True), key, radius)
    gone = found.where(F.col("component_id").isNotNull() & ~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("gone_key"), F.col("text_hash").alias("gone_hash")).distinct()
    own = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    ck, ct = f"c{df.columns.index(key)}", f"c{df.columns.index(text)}"
    kept = own.join(gone, F.col(ck).eqNullSafe(F.col("gone_key")) & F.xxhash64(F.col(ct).cast("string")).eqNullSafe(F.col("gone_hash")), "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
