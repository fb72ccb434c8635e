"""Katz back-off language model: bigrams that back off to unigrams, and those to one unknown word.

Counts are discounted by Good-Turing up to MOST, from the counts of counts or, where those don't give shares between 0 and 1, from
their log-linear fit; the mass taken from a context's seen words goes to the others by a back-off weight that is exactly
normalised. Words are told apart by 64-bit hashes; the words of the training texts get
ids, and bigrams are pairs of ids, so their counts are exact.

Tasks hold words and bigrams as sorted arrays, by chunks of documents, and only what differs within a chunk moves:

1. Each chunk's tokens are written as a table (places in the chunk's list of different words).
2. Each chunk asks the owners of its words, dealt by hash, which return ids and training counts (the unigram table).
3. Each chunk sends its different bigrams, with training counts, to the owners of their first words; those of frequent
   first words are dealt by both words. Owners count, write the bigram table, and answer every chunk in its own order with
   counts and, for each first word, what its back-off weight needs.
4. Each chunk scores its tokens by the answers. Sums of frequent first words, at most FREQUENT, are put together in between.

No task holds more than a chunk, or the part of the bigrams or words that it owns; the numbers of owners follow the counts.
A model's tables, unigrams by parts of the hashes and bigrams by owners, can be saved, loaded and asked about other texts.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words
from .common import slices, written

#: Counts up to which are discounted, bytes of a chunk's texts, different words and bigrams that an owner is sent, most words whose bigrams are dealt by both words.
MOST, CHUNK_BYTES, OWNED_WORDS, OWNED_BIGRAMS, FREQUENT = 5, 10 << 20, 1 << 20, 2 << 20, 1024
#: Counts whose numbers of types are gathered, for the log-linear fit; folders of a saved table.
FIT, FOLDERS = 40, 64
#: The end of a text as a word, and its beginning as a context. No word's hash is 0.
BOUNDARY = np.uint64(0)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def squeeze(a: np.ndarray) -> bytes:
    """An array of unsigned integers or floats: the narrowest type, by planes of bytes, compressed."""
    if a.dtype.kind != "f":
        most = int(a.max()) if len(a) else 0
        a = a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return (b"f" if a.dtype.kind == "f" else b"u") + bytes([a.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes)


def spread(b: bytes) -> np.ndarray:
    size = b[1]
    planes = zstandard.ZstdDecompressor().decompress(b[2:])
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(f"<{b[:1].decode()}{size}").ravel()


def fitted(n: np.ndarray) -> np.ndarray | None:
    """Numbers of types of count 1, 2, ... MOST + 1 on a line through the logarithms of all counts that occur, each spread over the gap around it; null for fewer than three counts or a line that falls too slowly for Good-Turing."""
    seen = np.flatnonzero(n[1:]) + 1
    if len(seen) < 3:
        return None
    before = np.concatenate([[0], seen[:-1]])
    after = np.concatenate([seen[1:], [2 * seen[-1] - before[-1]]])
    slope, level = np.polyfit(np.log(seen), np.log(2 * n[seen] / (after - before)), 1)
    return np.concatenate([[0.0], np.exp(level) * np.arange(1.0, MOST + 2) ** slope]) if slope < -1 else None


def turing(n: np.ndarray) -> np.ndarray | None:
    """Katz's shares of the counts 1..MOST from numbers of types by count; null unless all lie between 0 and 1."""
    r = np.arange(1, MOST + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = (MOST + 1) * n[MOST + 1] / n[1]
        d = ((r + 1) * n[2 : MOST + 2] / (r * n[1 : MOST + 1]) - rest) / (1 - rest)
    return d if np.isfinite(d).all() and (d > 0).all() and (d < 1).all() else None


def discounts(coc: np.ndarray) -> tuple[np.ndarray, str]:
    """Good-Turing's share of each count 0..MOST that stays, from how many types have count 1, 2, ... (coc[1:]), and how it was found.

    'counts': from those numbers as they are; 'fit': from their log-linear fit, where copies or small tables make them uneven; 'absolute': a
    constant is taken off, for tables of too few different counts for either.
    """
    out = np.ones(MOST + 1)
    n = np.concatenate([np.asarray(coc, float), np.zeros(FIT + 2)])[: FIT + 2]
    if n[1] <= 0:
        return out, "absolute"
    how = "counts"
    if (d := turing(n)) is None:
        how = "fit"
        line = fitted(n)
        d = None if line is None else turing(line)
    if d is None:
        how = "absolute"
        r = np.arange(1, MOST + 1)
        d = 1 - n[1] / (n[1] + 2 * n[2]) / r if n[2] > 0 else 1 - 0.5 / r
    out[1:] = d
    return out, how


class Unigrams:
    """Probabilities of words by their training counts; count 0 is the one unknown word."""

    def __init__(self, total: int, types: int, coc: np.ndarray):
        self.total, self.types = total, types
        self.share, self.how = discounts(coc)
        taken = float((np.arange(MOST + 1) * coc[: MOST + 1] * (1 - self.share)).sum())
        #: Without a count to discount, half a token is put aside for the unknown word.
        self.scale = 1.0 if taken > 0 else total / (total + 0.5)
        self.unknown = taken / total if taken > 0 else 0.5 / (total + 0.5)

    def p(self, count: np.ndarray) -> np.ndarray:
        kept = self.share[np.minimum(count, MOST)] * (count <= MOST) + (count > MOST)
        return np.where(count > 0, self.scale * kept * count / max(self.total, 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.types + 1)))


def seen_share(share: np.ndarray, context: np.ndarray, low: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For contexts by their counts and their numbers of followers of count 1..MOST: the factor of seen probabilities, and the mass left to others."""
    taken = sum((r + 1) * (1 - share[r + 1]) * n for r, n in enumerate(low))
    none = taken <= 0
    size = np.maximum(context, 1)
    return np.where(none, size / (size + 0.5), 1.0), np.where(none, 0.5 / (size + 0.5), taken / size)


def tokenize(docs: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """The written table of chunks."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in slices(batches, 2, CHUNK_BYTES):
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            learn = b.column(1).to_numpy(zero_copy_only=False)
            data, first, length, counts = words.cut(texts, words.NOT_BLANK)
            sizes = counts + 1
            tokens = np.full(int(sizes.sum()), BOUNDARY, np.uint64)
            tokens[np.arange(len(first)) + np.repeat(np.arange(len(counts)), counts)] = words.hashes(data, first, length)
            own, place, often = np.unique(tokens, return_inverse=True, return_counts=True)
            learned = np.bincount(place[np.repeat(learn, sizes)], minlength=len(own))
            by = np.argsort(-often, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(own), np.int64)
            rank[by] = np.arange(len(own))
            row = [[number], [b.column(0).to_pylist()], [learn.tolist()], [squeeze(sizes)], [own.tobytes()], [squeeze(learned)], [squeeze(by)], [squeeze(rank[place])], [len(own)], [len(tokens)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)
            number += 1

    columns = f"chunk long, keys array<{kind}>, train array<boolean>, sizes binary, words binary, learned binary, ranked binary, tokens binary, n_words long, n_tokens long"
    picked = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(train, F.lit(True)).alias("train"), F.col(f"`{text}`").cast("string").alias("t"))
    types = [pa.int64(), pa.list_(to_arrow_type(docs.schema[key].dataType)), pa.list_(pa.bool_()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
    names = [c.split()[0] for c in columns.split(", ")]
    return written(picked.mapInArrow(run, columns), "tokens")


def _power(n: int) -> int:
    return max(1, int(n - 1).bit_length())


def _stretches(owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(owner, low, high) of each run of equal values: only those that occur."""
    if len(owner):
        opens = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        yield from zip(owner[opens].tolist(), opens.tolist(), [*opens[1:].tolist(), len(owner)], strict=True)


_WORD_COLUMNS = "chunk long, part int, words binary, ids binary, counts binary, coc array<long>, total long, types long"
_WORD_TYPES = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64())


def word_parts(chunks: DataFrame) -> int:
    """Bits of the parts of words: by the hashes' first bits, so that a part is asked about OWNED_WORDS words or so."""
    asked = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    return _power(-(-asked // OWNED_WORDS) or 1)


def unigram_counts(chunks: DataFrame, bits: int, stored: DataFrame | None = None) -> DataFrame:
    """The written answers on words: rows (chunk, part, ids, counts) for chunks, in the order of their words' hashes; and, without a stored
    table (part, words, counts), rows with chunk null of the unigram table: words (hashes), counts, coc (types of count 0..FIT + 1), total and types."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, own, learned in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, learned = np.frombuffer(own, "<u8"), spread(learned)
                for part, lo, hi in _stretches((own >> np.uint64(64 - bits)).astype(np.int64)):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": [chunk], "words": [own[lo:hi].tobytes()], "learned": [squeeze(learned[lo:hi])]})

    def answer(table: pa.Table, held: pa.Table | None = None) -> pa.Table:
        rows: list[tuple] = []
        if not table.num_rows:
            return _table(rows, _WORD_TYPES, [c.split()[0] for c in _WORD_COLUMNS.split(", ")])
        part = table.column("part")[0].as_py()
        all_words = [np.frombuffer(w, "<u8") for w in table.column("words").to_pylist()]
        if held is None:
            learned = np.concatenate([spread(x) for x in table.column("learned").to_pylist()])
            flat = np.concatenate(all_words)
            known = np.unique(flat[learned > 0])
            counts = np.bincount(np.searchsorted(known, flat[learned > 0]), weights=learned[learned > 0].astype(float), minlength=len(known)).astype(np.int64)
        else:
            found = held.to_pylist()
            known = np.frombuffer(found[0]["words"], "<u8") if found else np.zeros(0, np.uint64)
            counts = spread(found[0]["counts"]).astype(np.int64) if found else np.zeros(0, np.int64)
        if len(known) and ((len(known) - 1) << bits) + part + 1 >= 1 << 32:
            raise OverflowError("more than 2**32 different words")
        for chunk, own in zip(table.column("chunk").to_pylist(), all_words, strict=True):
            at = _find(known, own)
            # A word's id is its place among its part's words, from 1; 0: not in the training texts. Places grow with the hashes, so their differences are small.
            rows.append((chunk, part, None, squeeze(at + 1), squeeze(_take(counts, at)), None, None, None))
        if held is None:
            coc = np.bincount(np.minimum(counts, FIT + 2), minlength=FIT + 3)[: FIT + 2]
            rows.append((None, part, known.tobytes(), None, squeeze(counts), coc.tolist(), int(counts.sum()), len(known)))
        return _table(rows, _WORD_TYPES, [c.split()[0] for c in _WORD_COLUMNS.split(", ")])

    asks = chunks.select("chunk", "words", "learned").mapInArrow(ask, "part int, chunk long, words binary, learned binary").groupBy("part")
    answers = asks.applyInArrow(lambda t: answer(t), _WORD_COLUMNS) if stored is None else asks.cogroup(stored.groupBy("part")).applyInArrow(lambda t, held: answer(t, held), _WORD_COLUMNS)
    return written(answers.withColumn("bits", F.lit(bits)), "unigrams")


class _Chunk:
    """A chunk's tokens with the answers on its words."""

    def __init__(self, row: dict, answers: pa.Table):
        self.sizes, self.train = spread(row["sizes"]).astype(np.int64), np.array(row["train"], bool)
        n = row["n_words"]
        ids, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        rows = sorted((r for r in answers.select(["part", "ids", "counts", "bits"]).to_pylist() if r["ids"] is not None), key=lambda r: r["part"])
        for r in rows:
            place = spread(r["ids"]).astype(np.int64)
            there = slice(at, at + len(place))
            ids[there] = np.where(place > 0, ((place - 1) << r["bits"]) + r["part"] + 1, 0)
            counts[there] = spread(r["counts"])
            at += len(place)
        if at != n:
            raise ValueError("a chunk lacks answers")
        by = spread(row["ranked"])
        tokens = spread(row["tokens"])
        self.id, self.count = ids[by][tokens], counts[by][tokens]
        opens = np.cumsum(self.sizes) - self.sizes
        self.before, self.before_count = np.roll(self.id, 1), np.roll(self.count, 1)
        self.before[opens], self.before_count[opens] = ids[0], counts[0]  # the boundary sorts first, and every text has one
        self.token_train = np.repeat(self.train, self.sizes)
        pair = (self.before.astype(np.uint64) << np.uint64(32)) | self.id.astype(np.uint64)
        pair[self.before == 0] = 0  # an unknown context has no bigram
        self.pair = pair
        #: All bigrams of known contexts that differ; an unknown second word (id 0) stands for the context alone.
        self.pairs, self.at = np.unique(pair, return_inverse=True)

    def owned(self, bits: int, often: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each owner, the places of its bigrams in pairs, where its contexts open among them, and which contexts are frequent."""
        first = self.pairs >> np.uint64(32)
        self.context_count = np.zeros(len(self.pairs), np.int64)
        self.context_count[self.at] = self.before_count
        frequent = self.context_count > often
        mixed = np.where(frequent, self.pairs, first) * _GOLD
        owner = ((mixed ^ (mixed >> np.uint64(31))) * _GOLD >> np.uint64(64 - bits)).astype(np.int64)
        by = np.argsort(owner, kind="stable")
        by = by[self.pairs[by] > 0]
        for o, lo, hi in _stretches(owner[by]):
            some = by[lo:hi]
            opens = np.flatnonzero(np.concatenate([[True], first[some][1:] != first[some][:-1]]))
            yield o, some, opens, frequent[some][opens]


_ANSWERS = "kind string, chunk long, owner int, first binary, runs binary, counts binary, low binary, sums binary, coc array<long>, share double"
_ANSWER_TYPES = (pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.float64())


def _table(rows: list[tuple], types: tuple, names: list[str]) -> pa.Table:
    return pa.table([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)


def bigram_counts(chunks: DataFrame, unigrams: DataFrame, model: Model, stored: DataFrame | None = None) -> DataFrame:
    """The written answers on bigrams, by kind: 'answer' (chunk, owner: counts of the chunk's bigrams in its order, and sums for its contexts); and, without a
    stored table, 'model' (the bigram table: contexts as differences, runs, counts, second words in low, sums), 'frequent' (what an owner has of a frequent context, its id as chunk), 'coc'."""
    bits, often, unigram = model.pair_bits, model.often, model.unigram
    names = [c.split()[0] for c in _ANSWERS.split(", ")]

    def send(chunk_rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in chunk_rows.to_pylist():
            c = _Chunk(row, answers)
            learned = np.bincount(c.at, weights=c.token_train, minlength=len(c.pairs)).astype(np.int64)
            second = np.zeros(len(c.pairs), np.int64)
            second[c.at] = c.count
            for o, some, opens, frequent in c.owned(bits, often):
                first = (c.pairs[some] >> np.uint64(32))[opens]
                parts = (np.diff(first, prepend=np.uint64(0)), np.diff(np.append(opens, len(some))), c.pairs[some] & np.uint64(0xFFFFFFFF), second[some], learned[some], frequent.astype(np.uint8))
                out.append((o, row["chunk"], *map(squeeze, parts)))
        return _table(out, (pa.int32(), pa.int64(), *[pa.binary()] * 6), ["owner", "chunk", "first", "runs", "second", "counts", "learned", "frequent"])

    number = lambda r, c: spread(r[c]).astype(np.int64)
    joined = lambda first, runs, second: np.repeat(first, runs).astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)

    def answer(table: pa.Table, held: pa.Table | None = None) -> pa.Table:
        rows = table.to_pylist()
        if not rows:
            return _table([], _ANSWER_TYPES, names)
        owner = rows[0]["owner"]
        firsts = [np.cumsum(number(r, "first")) for r in rows]
        pairs = [joined(f, number(r, "runs"), spread(r["second"])) for f, r in zip(firsts, rows, strict=True)]
        if held is None:
            flat, counts, learned = np.concatenate(pairs), np.concatenate([number(r, "counts") for r in rows]), np.concatenate([number(r, "learned") for r in rows])
            use = np.flatnonzero(learned > 0)
            known, at, back = np.unique(flat[use], return_index=True, return_inverse=True)
            total = np.bincount(back, weights=learned[use], minlength=len(known)).astype(np.int64)
        else:
            found = held.to_pylist()
            known, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if found:
                known, total = joined(np.cumsum(number(found[0], "first")), number(found[0], "runs"), spread(found[0]["low"])), number(found[0], "counts")
        # For each context: its followers of count 1..MOST, and the unigram probability of all its followers.
        own, opens = np.unique((known >> np.uint64(32)).astype(np.int64), return_index=True)
        add = lambda a: np.add.reduceat(a, opens) if len(own) else a[:0]
        low = [add((total == r).astype(np.int64)) for r in range(1, MOST + 1)]
        if held is None:
            sums = add(unigram.p(counts[use][at]))
        else:
            sums = spread(found[0]["sums"]) if found else np.zeros(0)
        out = []
        for r, f, p in zip(rows, firsts, pairs, strict=True):
            got, of = _find(known, p), _find(own, f)
            out.append(("answer", r["chunk"], owner, None, None, squeeze(_take(total, got)), squeeze(np.concatenate([_take(a, of) for a in low])), squeeze(_take(sums, of)), None, None))
        if held is None:
            if len(known):
                out.append(("model", None, owner, squeeze(np.diff(own, prepend=0)), squeeze(np.diff(np.append(opens, len(known)))), squeeze(total), squeeze(known & np.uint64(0xFFFFFFFF)), squeeze(sums), None, None))
            coc = np.bincount(np.minimum(total, FIT + 2), minlength=FIT + 3)[: FIT + 2]
            out.append(("coc", None, owner, None, None, None, None, None, coc.tolist(), None))
            frequent = np.unique(np.concatenate([f[number(r, "frequent") > 0] for f, r in zip(firsts, rows, strict=True)]))
            for i in np.flatnonzero(np.isin(own, frequent)).tolist():
                out.append(("frequent", int(own[i]), owner, None, None, None, None, None, [int(a[i]) for a in low], float(sums[i])))
        return _table(out, _ANSWER_TYPES, names)

    sent = chunks.select(*_CHUNK).groupBy("chunk").cogroup(unigrams.where("chunk IS NOT NULL").select("chunk", "part", "ids", "counts", "bits").groupBy("chunk"))
    sent = sent.applyInArrow(send, "owner int, chunk long, first binary, runs binary, second binary, counts binary, learned binary, frequent binary").groupBy("owner")
    found = sent.applyInArrow(lambda t: answer(t), _ANSWERS) if stored is None else sent.cogroup(stored.groupBy("owner")).applyInArrow(lambda t, held: answer(t, held), _ANSWERS)
    return written(found, "bigrams")


_CHUNK = ("chunk", "keys", "train", "sizes", "ranked", "tokens", "n_words")


def _find(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in a sorted array, -1 for what isn't there."""
    if not len(known):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def _take(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, a[at], 0) if len(a) else np.zeros(len(at), a.dtype)


@dataclass(frozen=True)
class Model:
    """A trained model: numbers, at most FREQUENT contexts, and its tables unigrams (part, words, counts) and bigrams (owner, first, runs, counts, low, sums)."""

    bits: int
    pair_bits: int
    total: int
    types: int
    coc: list[int]
    pair_coc: list[int]
    frequent: dict[int, list[float]]
    unigrams: DataFrame | None = None
    bigrams: DataFrame | None = None

    @property
    def often(self) -> int:
        return max(self.total // FREQUENT, 1)

    @cached_property
    def unigram(self) -> Unigrams:
        return Unigrams(self.total, self.types, np.array(self.coc))

    @cached_property
    def pair_discounts(self) -> tuple[np.ndarray, str]:
        return discounts(np.array(self.pair_coc))

    @property
    def discounting(self) -> tuple[str, str]:
        """How the discounts of words and of bigrams were found: 'counts', 'fit' or 'absolute'."""
        return self.unigram.how, self.pair_discounts[1]

    def numbers(self) -> Model:
        """Without the tables, as tasks get it."""
        return replace(self, unigrams=None, bigrams=None)

    def save(self, path: str) -> None:
        """Write the tables, in FOLDERS folders each, and the numbers."""
        for name, owner in (("unigrams", "part"), ("bigrams", "owner")):
            getattr(self, name).withColumn("folder", F.col(owner) % FOLDERS).write.partitionBy("folder").parquet(f"{path}/{name}")
        kept = {k: getattr(self, k) for k in ("bits", "pair_bits", "total", "types", "coc", "pair_coc")} | {"frequent": [[k, *v] for k, v in self.frequent.items()]}
        self.unigrams.sparkSession.createDataFrame([(json.dumps(kept),)], "numbers string").coalesce(1).write.parquet(f"{path}/numbers")


def load(spark: SparkSession, path: str) -> Model:
    kept = json.loads(spark.read.parquet(f"{path}/numbers").first()[0])
    kept["frequent"] = {int(k): v for k, *v in kept["frequent"]}
    table = lambda name, columns: spark.read.schema(f"{columns}, folder int").parquet(f"{path}/{name}").drop("folder")
    return Model(**kept, unigrams=table("unigrams", "part int, words binary, counts binary"), bigrams=table("bigrams", "owner int, first binary, runs binary, counts binary, low binary, sums binary"))


def _trained(docs: DataFrame, train: Column, key: str, text: str) -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """The model, and the chunks of docs with the answers on their words and bigrams."""
    chunks = tokenize(docs, key, text, train)
    bits = word_parts(chunks)
    unigrams = unigram_counts(chunks, bits)
    whole = unigrams.where("chunk IS NULL").agg(F.sum("total"), F.sum("types"), *[F.sum(F.col("coc")[i]) for i in range(FIT + 2)]).first()
    total, types, *coc = [int(x or 0) for x in whole]
    tokens = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    model = Model(bits, _power(-(-tokens // OWNED_BIGRAMS) or 1), total, types, coc, [], {})
    bigrams = bigram_counts(chunks, unigrams, model)
    seen = bigrams.where("kind = 'coc'").agg(*[F.coalesce(F.sum(F.col("coc")[i]), F.lit(0)) for i in range(FIT + 2)]).first()
    # At most FREQUENT contexts: their owners' sums are put together by Spark.
    often = bigrams.where("kind = 'frequent'").groupBy("chunk").agg(*[F.sum(F.col("coc")[i]).alias(f"n{i}") for i in range(MOST)], F.sum("share").alias("share"))
    frequent = {r[0]: [float(x) for x in r[1:]] for r in often.collect()}
    tables = unigrams.where("chunk IS NULL").select("part", "words", "counts"), bigrams.where("kind = 'model'").select("owner", "first", "runs", "counts", "low", "sums")
    model = replace(model, pair_coc=[int(x) for x in seen], frequent=frequent, unigrams=tables[0], bigrams=tables[1])
    logging.getLogger(__name__).info("discounts of words by %s, of bigrams by %s", *model.discounting)
    return model, chunks, unigrams, bigrams


def fit(docs: DataFrame, train: Column | None = None, key: str = "doc_id", text: str = "text") -> Model:
    """The model of the rows where `train` is true or null (all, without it)."""
    return _trained(docs, F.lit(True) if train is None else train, key, text)[0]


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, train, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs, learned from the rows where `train` is true (or null).

    Tokens are the text's words, A-Z lower-cased, and an end. base_score is that of unigrams with a half added to each count, score
    the back-off model's, both base-10 logarithms. Null texts have the end alone. Without training rows every word is the unknown
    one, whose probability is 1. Other columns don't take part; an empty table has no rows. A very long text is a chunk of its own.
    """
    return _scored(docs, key, *_trained(docs, train, key, text))


def score_by(model: Model, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """score of other texts by a stored model, from which its tables alone are asked; train is false."""
    chunks = tokenize(docs, key, text, F.lit(False))
    unigrams = unigram_counts(chunks, model.bits, model.unigrams)
    return _scored(docs, key, model, chunks, unigrams, bigram_counts(chunks, unigrams, model.numbers(), model.bigrams))


def _scored(docs: DataFrame, key: str, model: Model, chunks: DataFrame, unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    model = model.numbers()
    unigram, (share, _), bits, often, frequent, total = model.unigram, model.pair_discounts, model.pair_bits, model.often, model.frequent, model.total

    def final(chunk_rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in chunk_rows.to_pylist():
            c = _Chunk(row, answers.filter(pa.compute.is_null(answers.column("kind"))))
            of = {r["owner"]: r for r in answers.filter(pa.compute.is_valid(answers.column("kind"))).select(["owner", "counts", "low", "sums"]).to_pylist()}
            got, factor, back = np.zeros(len(c.pairs), np.int64), np.ones(len(c.pairs)), np.zeros(len(c.pairs))
            for o, some, opens, hot in c.owned(bits, often):
                got[some] = spread(of[o]["counts"])
                low = list(spread(of[o]["low"]).astype(np.float64).reshape(MOST, -1))
                sums = spread(of[o]["sums"]).copy()
                for i in np.flatnonzero(hot).tolist():
                    *lows, sums[i] = frequent.get(int(c.pairs[some[opens[i]]] >> np.uint64(32)), none_seen)
                    for a, n in zip(low, lows, strict=True):
                        a[i] = n
                kept, left = seen_share(share, c.context_count[some][opens], low)
                runs = np.diff(np.append(opens, len(some)))
                factor[some] = np.repeat(kept, runs)
                back[some] = np.repeat(np.log10(left / (1 - sums)), runs)
            logs = token_logs(unigram, share, c.count, c.before_count, got[c.at], factor[c.at], back[c.at])
            opens = np.cumsum(c.sizes) - c.sizes
            sums = [np.add.reduceat(a, opens) for a in ((c.count > 0).astype(np.int64), unigram.base(c.count), logs)]
            n = len(c.sizes)
            out.append(pa.table([pa.array(row["keys"], key_type), pa.array(c.train), pa.array(c.sizes), pa.array(sums[0]), pa.array(np.full(n, total, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in kinds], names=names)

    none_seen = [0.0] * (MOST + 1)
    key_type = to_arrow_type(docs.schema[key].dataType)
    names = ["key", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = (key_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    none = lambda kind: F.lit(None).cast(kind)
    both = unigrams.where("chunk IS NOT NULL").select("chunk", none("string").alias("kind"), "part", "ids", "counts", "bits", none("int").alias("owner"), none("binary").alias("low"), none("binary").alias("sums")).unionByName(
        bigrams.where("kind = 'answer'").select("chunk", "kind", none("int").alias("part"), none("binary").alias("ids"), "counts", none("int").alias("bits"), "owner", "low", "sums")
    )
    done = chunks.select(*_CHUNK).groupBy("chunk").cogroup(both.groupBy("chunk"))
    kind = docs.schema[key].dataType.simpleString()
    return done.applyInArrow(final, f"key {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)


def token_logs(model: Unigrams, share: np.ndarray, count: np.ndarray, context: np.ndarray, seen: np.ndarray, factor: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Each token's base-10 log-probability: of its bigram if that was seen; else its context's back-off weight, if the context was seen, and its word's."""
    kept = np.where(seen > MOST, 1.0, share[np.minimum(seen, MOST)])
    with np.errstate(divide="ignore", invalid="ignore"):
        bigram = np.log10(factor * kept * seen / context)
    return np.where(seen > 0, bigram, np.where(context > 0, back, 0.0) + np.log10(model.p(count)))
