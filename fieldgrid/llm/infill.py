"""Fill-in-the-middle: texts cut at unit borders into prefix, middle and suffix, put in another order between markers.

A pyarrow.compute pipeline over batches beside the scan: units become list arrays, which are flattened with their parents'
numbers; ordinals say what role each unit has, units of one role are filtered and made lists again, and binary joins put the
pieces together. No shuffle. All of it works on bytes: blanks are ASCII, so units are the same as over code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices

#: Blanks and the word after them, or blanks at the end: every character is in one unit.
UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: A byte that no UTF-8 text holds parts the units.
BORDER = b"\xff"
#: Bytes of text that are taken at a time; units and their numbers take some twenty times as much.
SLICE = 2 << 20


def draws(key: Column, seed: int = 42) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of the seed, a colon and the key; a null key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Rows (key, n long, form string, prefix_chars long, middle_chars long, output string), one for each row of df.

    n counts units. Texts without units, texts that hold a marker, and all but `rate` of a hundred others stay as they are (form
    plain, no lengths); of the rest `spm_rate` of a hundred have their suffix first (spm), the others their prefix (psm). Draws depend on
    seed and key alone, so repeated keys with equal texts come out equal. Null texts count as empty; other columns don't take part.
    A batch holds a whole text, which must stay under 1 GiB.
    """
    _check(markers)
    key_type = df.schema[key].dataType.simpleString()
    h = draws(F.col(f"`{key}`"), seed)
    picked = df.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{key}`").alias("key"), *(c.alias(f"h{i}") for i, c in enumerate(h)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, SLICE):
            made = _transformed(b.column(0), [b.column(i) for i in range(2, 6)], rate, spm_rate, [m.encode() for m in markers])
            yield pa.RecordBatch.from_arrays([b.column(1), *made.values()], names=["key", *made])

    return picked.mapInArrow(run, f"key {key_type}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", key)


def restore(df: DataFrame, output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """df with `restored`, the text before its transformation; an output without exactly three markers under psm or spm gives null.

    A form that is neither psm nor spm says that the output is the text. A column of df named restored is replaced.
    """
    _check(markers)
    df = df.drop("restored")
    at, kind = df.columns.index(output), df.columns.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, SLICE):
            back = _restored(b.column(at), b.column(kind), [m.encode() for m in markers])
            yield pa.RecordBatch.from_arrays([*b.columns, back], names=[*b.schema.names, "restored"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("restored", StringType())]))


def _check(markers: tuple[str, ...]) -> None:
    """Three markers of which none can begin within another, so an output is read in one way only."""
    if len(markers) != 3 or not all(markers):
        raise ValueError("three markers are needed")
    for a, b in [*permutations(markers, 2), *((m, m) for m in markers)]:
        if (a != b and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))) or markers.count(a) > 1:
            raise ValueError(f"markers {a} and {b} may overlap")


def _binary(text: pa.Array) -> pa.Array:
    return pc.fill_null(text.cast(pa.binary()), b"")


def _rest(a: pa.Array, b) -> pa.Array:
    """a modulo b."""
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _pieces(units: pa.ListArray, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Units before `low`, from there to before `high`, and the others, each joined."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    count = pc.list_value_length(units)
    ends = np.cumsum(count.to_numpy(zero_copy_only=False).astype(np.int64))
    first = pa.array(ends - count.to_numpy(zero_copy_only=False))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(first, parent))
    after_low, after_high = (pc.greater_equal(ordinal, pc.take(x, parent)) for x in (low, high))
    roles = pc.invert(after_low), pc.and_not(after_low, after_high), after_high
    sizes = low, pc.subtract(high, low), pc.subtract(pc.cast(count, pa.int64()), high)
    return [_joined(flat.filter(role), size) for role, size in zip(roles, sizes, strict=True)]


def _joined(flat: pa.Array, sizes: pa.Array) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes.to_numpy(zero_copy_only=False), out=offsets[1:])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat), b"")


def _characters(text: pa.Array) -> pa.Array:
    return pc.cast(pc.utf8_length(text.view(pa.string())), pa.int64())


def _transformed(text: pa.Array, h: list[pa.Array], rate: int, spm_rate: int, markers: list[bytes]) -> dict[str, pa.Array]:
    text = _binary(text)
    units = pc.split_pattern(pc.replace_substring_regex(text, UNIT, rb"\0" + BORDER), BORDER)
    n = pc.cast(pc.subtract(pc.list_value_length(units), 1), pa.int64())  # nothing stands behind the last border
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_rest(h[2], 100), rate))
    for m in markers:
        plain = pc.or_(plain, pc.match_substring(text, m))
    moved = pc.invert(plain)
    spm = pc.less(_rest(h[3], 100), spm_rate)
    cuts = [_rest(x, pc.add(n, 1)).filter(moved) for x in h[:2]]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    prefix, middle, suffix = _pieces(units.filter(moved), low, high)
    p, s, m = (pa.scalar(x, pa.binary()) for x in markers)
    back = spm.filter(moved)
    choose = lambda a, b: pc.if_else(back, a, b)
    output = pc.binary_join_element_wise(choose(s, p), choose(suffix, prefix), choose(p, s), choose(prefix, suffix), m, middle, pa.scalar(b"", pa.binary()))
    none = pa.nulls(len(text), pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.replace_with_mask(none, moved, _characters(prefix)),
        "middle_chars": pc.replace_with_mask(none, moved, _characters(middle)),
        "output": pc.replace_with_mask(text, moved, output).view(pa.string()),
    }


def _restored(output: pa.Array, form: pa.Array, markers: list[bytes]) -> pa.Array:
    output, form = _binary(output), pc.fill_null(form.cast(pa.string()), "")
    moved = pc.is_in(form, value_set=pa.array(["psm", "spm"]))
    parts = pc.split_pattern_regex(output.filter(moved), b"|".join(map(re.escape, markers)))
    spm = pc.equal(form.filter(moved), "spm")
    whole = pc.equal(pc.list_value_length(parts), 4)
    parts, spm = parts.filter(whole), spm.filter(whole)
    one, two, middle = (pc.list_element(parts, i) for i in (1, 2, 3)) if len(parts) else [pa.array([], pa.binary())] * 3
    text = pc.binary_join_element_wise(pc.if_else(spm, two, one), middle, pc.if_else(spm, one, two), pa.scalar(b"", pa.binary()))
    back = pc.replace_with_mask(pa.nulls(len(whole), pa.binary()), whole, text)
    return pc.replace_with_mask(output, moved, back).view(pa.string())
