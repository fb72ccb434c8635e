"""Language identification by compression.

Each language has a zstandard raw-content dictionary cut from labelled texts. A text, as lower-case words without digits and
marks, is compressed in blocks with the dictionary of every language; the language with the smallest total wins, and a narrow margin over the next rejects.
Blocks are short, so that a long text doesn't become its own dictionary; all blocks of a text are coded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices

#: Bounds of the sample that a model is fitted on: languages (those of most rows), texts of a language, and characters taken of each.
LANGUAGES, TEXTS, CHARACTERS = 256, 200, 400
#: Bytes of a block, zstandard's level, and the least relative margin (of the second best total) that isn't rejected.
BLOCK, LEVEL, MARGIN = 1024, 9, 0.004


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", texts: int = TEXTS, characters: int = CHARACTERS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """The raw dictionary of each language: excerpts of `texts` rows with a label and a text, picked by a hash of their key.

    An excerpt begins anywhere in its text, by a hash of key and text. The `languages` labels of most rows are learned (ties: the first
    name), and stand in that order. Rows with a null or empty text or a null label aren't learned from; no rows give an empty
    model. Its size is at most languages x texts x characters, so it is held by the driver.
    """
    known = labelled.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull() & (F.length(f"`{text}`") > 0))
    offset = F.pmod(F.xxhash64(f"`{key}`", f"`{text}`"), F.greatest(F.length(f"`{text}`") - 2 * characters, F.lit(0)) + 1).cast("int")
    rows = known.select(F.col(f"`{label}`").cast("string").alias("l"), F.xxhash64(f"`{key}`").alias("h"), F.substring(F.col(f"`{text}`"), offset + 1, F.lit(2 * characters)).alias("t"))
    counts = {r.l: r.n for r in known.groupBy(F.col(f"`{label}`").cast("string").alias("l")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l").limit(languages).collect()}
    # row_number() <= n is cut to n rows a language in every task before the exchange.
    first = rows.where(F.col("l").isin(*counts)).withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("n") <= texts)
    model: dict[str, list[tuple[int, str]]] = {}
    for r in first.collect() if counts else ():
        model.setdefault(r.l, []).append((r.n, plain(r.t)[:characters]))
    return {k: " ".join(t for _, t in sorted(model[k])).encode() for k in sorted(model, key=lambda k: (-counts[k], k))}


def plain(text: str) -> str:
    """Lower-case words without digits and marks, one blank between."""
    return _OTHER.sub(" ", text.lower())


_OTHER = re.compile(r"[\W\d_]+")


class Compressors:
    def __init__(self, model: dict[str, bytes], level: int):
        self.labels = list(model)
        self.coders = []
        for content in model.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str, block: int) -> list[int]:
        data = plain(text).encode()
        parts = [data[i : i + block] for i in range(0, len(data), block)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders]

    def decide(self, text: str | None, block: int, margin: float) -> tuple[str, float, bool]:
        """The language, the score, and whether it is rejected."""
        if not self.labels or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(text, block)
        best = int(np.argmin(sizes))
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        score = 1.0 if rest is None else 1 - sizes[best] / rest
        return self.labels[best], score, score < margin


def keep_decided(df: DataFrame, model: dict[str, bytes], text: str = "text", block: int = BLOCK, level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """The rows of df whose language isn't rejected, with all their columns; the rows stay where they are."""
    column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Compressors(model, level)
        for b in slices(batches, column):
            yield b.filter(pa.array([not coders.decide(t, block, margin)[2] for t in b.column(column).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def predict(df: DataFrame, model: dict[str, bytes], key: str = "doc_id", text: str = "text", block: int = BLOCK, level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """Rows (key, lang_pred, score, rejected), one for each row of df.

    score is 1 - best / second best total (1 with a single language). A null text, one without a letter and an empty
    model give `und`, score 0, rejected. Ties go to the model's first label and are rejected. Other columns don't take part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Compressors(model, level)
        for b in slices(batches, 1):
            names, scores, rejected = zip(*(coders.decide(t, block, margin) for t in b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["key", "lang_pred", "score", "rejected"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)
