"""Benchmark decontamination by suffix arrays of the training texts.

Every task sorts the word suffixes of its shard of documents (prefix doubling over word ranks, to the depth of the
longest benchmark text) and binary-searches all suffixes of the benchmark in it, which gives each suffix's longest
verbatim match and all its places. The benchmark is read by the tasks from a written table, in blocks; neither it nor
the documents pass through the driver, and the documents aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import scratch, slices

#: Words of a window, bytes of a shard's text, and rows of the benchmark that a task holds at a time.
WINDOW, SHARD_BYTES, BLOCK_ROWS = 13, 6 << 20, 20_000


def order(rank: np.ndarray, then: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The positions `at` sorted by (rank, then, position); all are below n."""
    bits = max(int(n).bit_length(), 1)
    if 3 * bits <= 64:  # one plain sort of packed integers
        b = np.uint64(bits)
        packed = (rank.astype(np.uint64) << (b + b)) | (then.astype(np.uint64) << b) | at.astype(np.uint64)
        packed.sort()
        return (packed & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
    return at[np.lexsort((at, then, rank))]


def suffix_array(hashes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the words from them on, compared for `depth` words at least; the words' order is their hashes'."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(int(n).bit_length(), 1))
    packed = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    packed.sort()
    suffixes = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    of = hashes[suffixes]
    if (of[1:] < of[:-1]).any():  # the hashes of two words differ in their low bits alone
        suffixes = np.argsort(hashes, kind="stable")
        of = hashes[suffixes]
    opens = np.concatenate([[True], of[1:] != of[:-1]])
    group = np.maximum.accumulate(np.where(opens, np.arange(n), 0))  # a rank is the place where its group begins
    rank = np.empty(n + 1, np.int64)
    rank[suffixes] = group
    rank[n] = -1
    h = 1
    while h < depth:
        closes = np.concatenate([opens[1:], [True]])
        tied = np.flatnonzero(~(opens & closes))
        if not len(tied):
            break
        at = suffixes[tied]
        then = rank[np.minimum(at + h, n)] + 1
        at = order(rank[at], then, at, n + 1)
        suffixes[tied] = at
        one, two = rank[at], rank[np.minimum(at + h, n)]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        opens[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        h *= 2
    return suffixes


def narrow(hashes: np.ndarray, suffixes: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range of suffixes, equal in `depth` words, the part whose next word is the given one."""
    n = len(hashes)

    def bound(low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            place = suffixes[middle] + depth
            there = hashes[np.minimum(place, n - 1)]
            there[place >= n] = 0
            right = there <= word[live] if after else there < word[live]
            low[live[right]] = middle[right] + 1
            high[live[~right]] = middle[~right]
            live = live[low[live] < high[live]]
        return low

    start = bound(low, high, False)
    return start, bound(start, high, True)


class Benchmark:
    """Word hashes of a block of benchmark texts; suffix i begins at word i and ends with its text."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        data, first, length, counts = words.cut([(t or "").encode() for t in texts], words.ALPHANUMERIC)
        self.hashes = words.hashes(data, first, length)
        self.ids = np.array(ids, object)
        self.item = np.repeat(np.arange(len(texts)), counts)
        ends = np.repeat(np.cumsum(counts), counts)
        self.left = ends - np.arange(len(self.item))  # words from here to the end of the text
        self.size = np.repeat(counts, counts)
        self.longest = int(counts.max(initial=0))


class Shard:
    """Some documents: their word hashes, each document followed by the hash 0, which no word has, and their suffix array."""

    def __init__(self, texts: list[bytes], depth: int):
        data, first, length, counts = words.cut(texts, words.ALPHANUMERIC)
        self.counts = counts
        self.starts = np.cumsum(counts + 1) - counts - 1
        self.hashes = np.zeros(int(counts.sum()) + len(counts), np.uint64)
        self.document = np.repeat(np.arange(len(counts)), counts + 1)
        place = np.arange(int(counts.sum())) + np.repeat(np.arange(len(counts)), counts)
        self.hashes[place] = words.hashes(data, first, length)
        self.suffixes = suffix_array(self.hashes, depth)

    def search(self, bench: Benchmark, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix of the benchmark: words of its longest match, the range of its places; and the range at which its first window (or whole short text) stands."""
        m = len(bench.hashes)
        low, high = np.zeros(m, np.int64), np.full(m, len(self.suffixes), np.int64)
        length, best_low, best_high = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        need = np.where(bench.size >= window, window, bench.size)
        at_low, at_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
        live = np.arange(m) if len(self.suffixes) else np.zeros(0, np.int64)
        depth = 0
        while len(live):
            lo, hi = narrow(self.hashes, self.suffixes, low[live], high[live], depth, bench.hashes[live + depth])
            found = hi > lo
            live, lo, hi = live[found], lo[found], hi[found]
            depth += 1
            low[live], high[live] = lo, hi
            length[live], best_low[live], best_high[live] = depth, lo, hi
            whole = live[need[live] == depth]
            at_low[whole], at_high[whole] = low[whole], high[whole]
            live = live[bench.left[live] > depth]
        return length, best_low, best_high, at_low, at_high

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of the ranges, and which range each is of."""
        size = high - low
        of = np.repeat(np.arange(len(low)), size)
        return self.suffixes[np.repeat(low, size) + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)], of


def _runs(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Slices of consecutive entries whose sizes sum to at most `most`, or of one entry."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
        yield slice(start, stop)
        start = stop


def _blocks(folder: str) -> Iterator[Benchmark]:
    """The written benchmark, BLOCK_ROWS at a time; the tasks read it from the shared folder."""
    fs, base = pafs.FileSystem.from_uri(folder)
    for b in ds.dataset(base, filesystem=fs, format="parquet", exclude_invalid_files=True).to_batches(batch_size=BLOCK_ROWS):
        if b.num_rows:
            yield Benchmark(b.column("id").to_pylist(), b.column("text").to_pylist())


def _prepared(benchmark: DataFrame, item: str, text: str) -> tuple[str, int]:
    """The folder of the benchmark's table, and the most characters of a text, which bounds the depth of the search."""
    folder = scratch(benchmark.sparkSession, "benchmark")
    picked = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    picked.where("text <> ''").write.parquet(folder)
    most = benchmark.sparkSession.read.schema("id string, text string").parquet(folder).agg(F.max(F.length("text"))).first()[0] or 0
    return folder, most // 2 + 1


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (key, n_words, n_hit, items array<string>), one for each row of docs.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A word is hit if it lies in an
    occurrence of `window` consecutive words of a benchmark text, or of a whole text of fewer; items are the ids, as
    strings, of the texts that occur so. Null texts have no words, null ids count as the empty id. An empty benchmark
    hits nothing. Other columns don't take part. Repeated words and windows cost memory in proportion to the texts.
    """
    folder, depth = _prepared(benchmark, item, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _Measure(folder, depth, window)
        for b in slices(batches, 1, SHARD_BYTES):
            counts, n_hit, items = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["key", "n_words", "n_hit", "items"])

    return _run(docs, key, text, run, "n_words long, n_hit long, items array<string>")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; the rows stay where they are."""
    folder, depth = _prepared(benchmark, item, item_text)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _Measure(folder, depth, window)
        for b in slices(batches, column, SHARD_BYTES):
            counts, n_hit, _ = measure(b.column(column))
            yield b.filter(pa.array((n_hit == 0) | (20 * n_hit < counts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class _Measure:
    """A task's measure of texts: words, hit words and items of each. A benchmark of one block is kept for all shards."""

    def __init__(self, folder: str, depth: int, window: int):
        self.folder, self.depth, self.window = folder, depth, window
        self.kept = list(_first(_blocks(folder)))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
        one = len(self.kept) < 2
        longest = max((k.longest for k in self.kept), default=0) if one else self.depth
        shard = Shard(texts, min(self.depth, max(longest, self.window)))
        change = np.zeros(len(shard.hashes) + 1, np.int64)
        items: dict[int, set] = {}
        for bench in self.kept if one else _blocks(self.folder):
            _, _, _, low, high = shard.search(bench, self.window)
            use = np.flatnonzero(high > low)
            # Equal windows stand in one range, whose places are taken once; ranges of one size don't share places.
            size = np.minimum(bench.size[use], self.window)
            ranges, of = np.unique(np.stack([low[use], high[use], size]), axis=1, return_inverse=True)
            wanted = np.unique(np.stack([of.ravel(), bench.item[use]]), axis=1)
            first = np.searchsorted(wanted[0], np.arange(ranges.shape[1] + 1))
            for some in _runs(ranges[1] - ranges[0]):
                place, at = shard.places(ranges[0, some], ranges[1, some])
                at += some.start
                change += np.bincount(place, minlength=len(change)) - np.bincount(place + ranges[2, at], minlength=len(change))
                met = np.unique(np.stack([at, shard.document[place]]), axis=1)
                many = first[met[0] + 1] - first[met[0]]
                for part in _runs(many):
                    n = many[part]
                    document = np.repeat(met[1, part], n)
                    item = wanted[1, np.repeat(first[met[0, part]], n) + np.arange(len(document)) - np.repeat(np.cumsum(n) - n, n)]
                    both = np.unique(np.stack([document, item]), axis=1)
                    for r, i in zip(both[0].tolist(), bench.ids[both[1]].tolist(), strict=True):
                        items.setdefault(r, set()).add(i)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
        return shard.counts, hit[shard.starts + shard.counts] - hit[shard.starts], [sorted(items.get(r, ())) for r in range(len(texts))]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = WINDOW) -> DataFrame:
    """Longest verbatim matches: rows (key, item string, item_word, doc_word, n_words), words counted from 0.

    One for each suffix of a benchmark text and each place in its task's shard where the suffix's longest match of that
    shard stands, if it has `least` words or is a whole shorter text, and isn't part of a longer one to its left.
    """
    folder, depth = _prepared(benchmark, item, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SHARD_BYTES):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            shard = Shard(texts, depth)
            for bench in _blocks(folder):
                length, low, high, _, _ = shard.search(bench, least)
                use = np.flatnonzero(length >= np.minimum(bench.size, least))
                for some in _runs(high[use] - low[use]):
                    place, of = shard.places(low[use[some]], high[use[some]])
                    of = use[some][of]
                    word = bench.size[of] - bench.left[of]
                    before = np.where(place > 0, shard.hashes[place - 1], 0)
                    inner = (word > 0) & (before == bench.hashes[of - 1]) & (before != 0)
                    place, of, word = place[~inner], of[~inner], word[~inner]
                    document = shard.document[place]
                    for i in range(0, len(place), 50_000):
                        s = slice(i, i + 50_000)
                        d = document[s]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(bench.ids[bench.item[of[s]]].tolist(), pa.string()), pa.array(word[s]), pa.array(place[s] - shard.starts[d]), pa.array(length[of[s]])], names=["key", "item", "item_word", "doc_word", "n_words"])

    return _run(docs, key, text, run, "item string, item_word long, doc_word long, n_words long")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A twentieth of the words or more are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def _first(blocks: Iterator[Benchmark]) -> Iterator[Benchmark]:
    """The first two blocks: with one alone, a task keeps it for all its shards."""
    for i, b in enumerate(blocks):
        yield b
        if i:
            break


def _run(docs: DataFrame, key: str, text: str, run, columns: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, f"key {kind}, {columns}").withColumnRenamed("key", key)

