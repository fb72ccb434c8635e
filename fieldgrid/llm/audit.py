"""How quality filters overlap: what each removes, would remove alone, or removes in vain, in every order of application.

Equal texts are found in three steps. Tasks count texts in counting Bloom sketches, which are merged by segments; where a counter of
a text is below two, no other text is equal to it. Only the other texts are shuffled, whole, for their smallest ids.
Then the failed filters of each document form a mask, masks are counted, and every order's numbers are sums of counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations
from math import ceil, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from .common import join_hot, scratch, written

#: Failure conditions in SQL over text, n_words, n_distinct, n_upper and n_chars; the filter of repeated texts comes after them.
FILTERS = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_upper > 2 * n_chars", "D": "text RLIKE '[#$%&*|]'"}
DUPLICATE = "E"
#: Counters of a segment, counters that a text raises, and counters for each row of the table: about one unique text in 400 isn't cleared.
SEGMENT, PLACES, SHARE = 1 << 20, 4, 16
#: Bytes of a merged sketch that every worker may hold, enough for 33 million rows; larger ones stay in segments.
WORKER_BYTES = 64 << 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def measured(text: Column) -> list[Column]:
    """What the conditions compare; words are runs of [^ \\t-\\r]."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return [
        F.size(words).alias("n_words"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
        F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).alias("n_upper"),
        F.char_length(text).alias("n_chars"),
    ]


def _segment(segments: int) -> Column:
    """The segment of a hash, by its upper half."""
    return F.shiftright(F.shiftrightunsigned("h", 32) * segments, 32).cast("int")


def _places(h: np.ndarray, segments: int) -> np.ndarray:
    """The numbers of the counters of each hash, over all segments: different ones, all in one segment."""
    h = h.view(np.uint64)
    segment = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    step = (h * SPREAD) >> np.uint64(44) | np.uint64(1)
    at = (h[:, None] + np.arange(PLACES, dtype=np.uint64) * step[:, None]) & np.uint64(SEGMENT - 1)
    return (segment[:, None] * np.uint64(SEGMENT) + at).astype(np.int64)


def sketch(hashes: DataFrame, segments: int) -> str:
    """The folder of the merged sketch of rows (h long): rows (segment, bits), a bit for each counter that reached two.

    A task sends the counters that its batches raised, not whole sketches, and a count over two as two: many copies weigh no more than two.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, count = np.unique(_places(b.column(0).to_numpy(), segments).ravel(), return_counts=True)
            segment, at = place // SEGMENT, (place % SEGMENT).astype("<u4")
            twice = (count > 1).astype(np.uint8)
            found, first = np.unique(segment, return_index=True)
            cut = list(zip(first, [*first[1:], len(place)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([at[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([twice[i:j].tobytes() for i, j in cut], pa.binary())], names=["segment", "at", "twice"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(SEGMENT, np.uint8)
        for at, twice in zip(table.column("at"), table.column("twice"), strict=True):
            place = np.frombuffer(at.as_buffer(), "<u4")
            total[place] = np.minimum(total[place] + 1 + np.frombuffer(twice.as_buffer(), np.uint8), 2)
        return pa.table({"segment": table.column("segment")[:1].cast(pa.int32()), "bits": pa.array([np.packbits(total > 1).tobytes()], pa.binary())})

    folder = scratch(hashes.sparkSession, "sketch")
    parts = hashes.select("h").mapInArrow(partial, "segment int, at binary, twice binary")
    parts.groupBy("segment").applyInArrow(merge, "segment int, bits binary").write.option("compression", "zstd").parquet(folder)
    return folder


def _test(h: np.ndarray, bits: np.ndarray, segments: int, first: int = 0) -> np.ndarray:
    """Which hashes may have come twice."""
    place = _places(h, segments) - first * SEGMENT
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).all(axis=1)


_held: dict[str, np.ndarray] = {}


def _bits(folder: str, segments: int) -> np.ndarray:
    """The whole merged sketch, which a worker reads once from the shared folder."""
    if folder not in _held:
        _held.clear()
        bits = np.zeros((segments, SEGMENT // 8), np.uint8)
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in ds.dataset(base, filesystem=fs, format="parquet", exclude_invalid_files=True).to_batches(batch_size=64):
            for segment, row in zip(b.column("segment").to_pylist(), b.column("bits"), strict=True):
                bits[segment] = np.frombuffer(row.as_buffer(), np.uint8)
        _held[folder] = bits.ravel()
    return _held[folder]


def possible_repeats(df: DataFrame, rows: int, most: int = WORKER_BYTES) -> DataFrame:
    """df, which has the hash h of a text, with `possible`: false where no other row's text is equal.

    A sketch of up to `most` bytes is read whole by each worker, and no row moves. A larger one is asked by segments: different hashes
    go to their segments, and rows meet the answers by their hashes, which moves whole rows.
    """
    segments = max(1, ceil(rows * SHARE / SEGMENT))
    folder = sketch(df.select("h"), segments)
    if segments * SEGMENT // 8 <= most:

        @F.pandas_udf("boolean")
        def possible(h: pd.Series) -> pd.Series:
            return pd.Series(_test(h.to_numpy(), _bits(folder, segments), segments))

        return df.withColumn("possible", possible("h"))

    def ask(hashes: pa.Table, found: pa.Table) -> pa.Table:
        h = hashes.column("h").to_numpy()
        bits = np.frombuffer(found.column("bits")[0].as_buffer(), np.uint8)
        return pa.table({"h": pa.array(h[_test(h, bits, segments, found.column("segment")[0].as_py())], pa.int64())})

    merged = df.sparkSession.read.schema("segment int, bits binary").parquet(folder)
    asked = df.select("h").distinct().withColumn("segment", _segment(segments)).groupBy("segment").cogroup(merged.groupBy("segment")).applyInArrow(ask, "h long")
    return df.join(written(asked, "possible").withColumn("possible", F.lit(True)), "h", "left").withColumn("possible", F.coalesce("possible", F.lit(False)))


def later_copies(rows: DataFrame) -> DataFrame:
    """Of rows (k, h, text, possible, others), those whose text is also that of a row with a smaller k.

    Texts are grouped whole, with partial minima before the exchange. The rows then meet a group by the text's hash, and where groups of
    different texts have one hash, by the text.
    """
    maybe = rows.where("possible")
    groups = maybe.groupBy("h", "text").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n")).where("first < last")
    groups = written(groups.select("h", "text", "first", "n"), "groups")
    shared = written(groups.groupBy("h").count().where("count > 1").select("h"), "shared")
    # Two texts with one hash among the repeated ones: none, or very few.
    alone = groups.select("h", "first", "n").join(shared, "h", "left_anti")
    found = join_hot(maybe.drop("text"), alone, "h", "n").where("k > first").drop("first", "n")
    if not shared.isEmpty():
        mixed = groups.join(shared, "h").drop("n")
        found = found.unionByName(maybe.join(mixed, ["h", "text"]).where("k > first").drop("first", "text"))
    return found


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, duplicate: str = DUPLICATE, key: str = "doc_id", text: str = "text", part: str = "source", most: int = WORKER_BYTES) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order of filters and step.

    kept and removed count the documents of the part after and by this step's filter, redundant those that fail it but went before,
    unique_fails those that fail no other, good_lost and toxic_lost the removed ones with quality or toxic 1 in labels, shapley what the
    filter removes summed over all orders. Null texts and parts count as empty. A row with a null key is never a later copy and has no labels;
    repeated keys are separate documents; repeated labels count once, if any says 1. No documents give no rows. Other columns don't take part.
    """
    letters = [*filters, duplicate]
    if len(letters) > 6:
        raise ValueError("orders of more than six filters are too many to list")
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{key}`").alias("k"), empty(part).alias("part"), empty(text).alias("text"))
    mask = sum((F.when(F.expr(condition), 1 << i).otherwise(0) for i, condition in enumerate(filters.values())), F.lit(0))
    flagged = base.select("*", *measured(F.col("text"))).select("k", "part", mask.alias("mask"), F.xxhash64("text").alias("h"), "text")
    asked = possible_repeats(flagged, base.count(), most)
    rows = written(asked.select("k", "part", "mask", "h", "possible", F.when(F.col("possible"), F.col("text")).alias("text")), "flags")
    # A later copy leaves its mask and joins the one with the last filter.
    copies = written(later_copies(rows).select("k", "part", "mask"), "copies")
    step = lambda df, m, n: df.select("k", "part", m.alias("mask"), F.lit(n).alias("docs"))
    moves = step(rows, F.col("mask"), 1).union(step(copies, F.col("mask"), -1)).union(step(copies, F.col("mask") + (1 << len(filters)), 1))
    known = labels.groupBy(F.col(f"`{key}`").alias("k")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1")
    own = F.col("docs")
    told = moves.join(known, "k").select("part", "mask", F.lit(0).alias("docs"), (own * F.coalesce("good", F.lit(0))).alias("good"), (own * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    plain = moves.select("part", "mask", "docs", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    counts = plain.union(told).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("docs", "good", "toxic")))
    return _report(counts, letters)


def _report(counts: DataFrame, letters: list[str]) -> DataFrame:
    """The report from rows (part, mask, docs, good, toxic), at most 2^filters a part: arrays of the rows that pass a set of filters tell all."""
    n, docs = len(letters), "get(docs, {})".format
    array = lambda values: f"array({', '.join(map(str, values))})"
    passing = lambda c: F.expr(array(f"sum(if(mask & {s} = 0, {c}, 0))" for s in range(1 << n))).alias(c)
    sums = counts.groupBy("part").agg(*map(passing, ("docs", "good", "toxic")))
    every, shares = (1 << n) - 1, []
    for i in range(n):
        others = [1 << j for j in range(n) if j != i]
        sets = [sum(c) for size in range(n) for c in combinations(others, size)]
        # A set stands before the filter in so many orders.
        times = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in sets]
        shares.append(" + ".join(f"{t} * ({docs(s)} - {docs(s | 1 << i)})" for s, t in zip(sets, times, strict=True)))
    alone = array(f"{docs(every ^ 1 << i)} - {docs(every)}" for i in range(n))
    sums = sums.select("*", F.expr(array(shares)).alias("shapley"), F.expr(alone).alias("alone"))
    orders = list(permutations(range(n)))
    before = [sum(1 << j for j in o[:i]) for o in orders for i in range(n)]
    numbered = sums.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = f"o * {n} + i"
    placed = numbered.select("*", F.expr(f"get({array(before)}, {at})").alias("b"), F.expr(f"get({array(j for o in orders for j in o)}, {at})").alias("f"))
    placed = placed.withColumn("a", F.expr("b | shiftleft(1, f)"))
    names = array(repr("".join(letters[j] for j in o)) for o in orders)
    lost = lambda c: F.get(c, F.col("b")) - F.get(c, F.col("a"))
    return placed.select(
        "part",
        F.expr(f"get({names}, o)").alias("filter_order"),
        (F.col("i") + 1).alias("step"),
        F.get("docs", F.col("a")).alias("kept"),
        lost("docs").alias("removed"),
        (F.get("docs", F.lit(0)) - F.get("docs", F.expr("shiftleft(1, f)")) - lost("docs")).alias("redundant"),
        F.get("alone", F.col("f")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("f")).alias("shapley"),
    )
