"""BPE encoding and decoding.

A word is encoded by a priority queue of merge ranks over a doubly linked list of symbols: the best pair is
popped, pairs that a former merge has made stale are skipped, and the two new neighbour pairs are pushed. Ids are
decoded by concatenating vocabulary strings. Both run in Arrow batches next to the scan, with no shuffle: a text
is the concatenation of its whitespace-separated chunks, and each worker keeps a bounded memo of encoded chunks.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import list_array, slices

#: Chunks that a worker remembers (it forgets all when full), and their most characters: longer ones are encoded each time, so a memo's bytes are bounded.
MEMO_CHUNKS, MEMO_CHARACTERS = 400_000, 64


#: Normalizer and pre-tokenizer of the tokenizer files that Bpe reads.
KIND = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(printable))
    return table


class Bpe:
    """A tokenizer file of the kind: NFC, blanks to one space, lower case; pattern split; byte-level BPE with a word end. Others raise an error."""

    def __init__(self, path: str, memo: int = MEMO_CHUNKS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(spec[part] != value for part, value in KIND.items()):
            raise ValueError(f"{path} is another kind of tokenizer file")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.strings = [""] * (max([*self.vocab.values(), *self.specials.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.specials.items()]:
            self.strings[i] = token
        self.byte = byte_characters()
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, list[int]] = {}
        self.most = memo

    def word(self, word: str) -> list[int]:
        """Merge the word's symbols, best rank first and leftmost among equals."""
        chars = [self.byte[b] for b in word.encode("utf-8")]
        chars[-1] += self.end
        ids = [self.vocab[c] for c in chars if c in self.vocab]
        n, merges = len(ids), self.merges
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # a former merge took one of the two
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((merged, ids[k])):
                    heapq.heappush(queue, (found[0], i, merged, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], merged))):
                heapq.heappush(queue, (found[0], h, ids[h], merged, found[1]))
        return [i for i in ids if i >= 0]

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space, as little-endian 32-bit integers."""
        ids: list[int] = []
        for part in self.special.split(chunk) if self.special else [chunk]:
            if part in self.specials:
                ids.append(self.specials[part])
                continue
            part = part.lower() if part.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", part)))
            for word in self.pattern.findall(part):
                if (known := self.words.get(word)) is None:
                    known = self.word(word)
                    if len(word) <= MEMO_CHARACTERS:
                        if len(self.words) >= self.most:
                            self.words.clear()
                        self.words[word] = known
                ids += known
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str | None) -> bytes:
        out, memo = [], self.memo
        for chunk in chunks(text):
            if (known := memo.get(chunk)) is None:
                known = self.chunk(chunk)
                if len(chunk) <= MEMO_CHARACTERS:
                    if len(memo) >= self.most:
                        memo.clear()
                    memo[chunk] = known
            out.append(known)
        return b"".join(out)


_BLANK = regex.compile(r"\s+")
_ODD = regex.compile("[\x1c-\x1f]")


def chunks(text: str | None) -> list[str]:
    """The text's pieces between Unicode white space, which no token crosses (str.split also parts at four separators that aren't white space)."""
    if not text:
        return []
    return [c for c in _BLANK.split(text) if c] if _ODD.search(text) else text.split()


_models: dict[tuple, Bpe] = {}


def model(path: str) -> Bpe:
    """One for each worker process, with its memo."""
    if (path,) not in _models:
        _models[path,] = Bpe(path)
    return _models[path,]


def encode_batches(path: str, texts: pa.Array) -> pa.ListArray:
    """Ids of each text; null encodes as the empty text."""
    bpe = model(path)
    coded = [bpe.encode(t) for t in texts.to_pylist()]
    return list_array(np.frombuffer(b"".join(coded), "<i4"), np.array([len(c) // 4 for c in coded], np.int64), pa.int32())


def decode_batches(path: str, ids: pa.ListArray, between: str) -> pa.Array:
    """The vocabulary strings of each list; null lists give the empty text, ids outside the vocabulary nothing."""
    table = pa.array(model(path).strings, pa.string())
    flat = ids.flatten()
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
    strings = pc.take(table, pc.if_else(inside, flat, None))
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pc.fill_null(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.fill_null(strings, "")), between), "")


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>), one for each row of df, repeated rows included; null text: no ids. Other columns don't take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), encode_batches(path, b.column(1))], names=["key", "ids"])

    return _keyed(df, key, text, "string", run, "ids array<int>")


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", between: str = " ") -> DataFrame:
    """Rows (key, decoded string): the ids' vocabulary strings, parted by `between`; null ids: empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), decode_batches(path, b.column(1), between)], names=["key", "decoded"])

    return _keyed(df, key, ids, "array<int>", run, "decoded string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", between: str = " ") -> DataFrame:
    """encode and then decode of its ids, in one pass: rows (key, ids array<int>, decoded string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 2 << 20):
            ids = encode_batches(path, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, decode_batches(path, ids, between)], names=["key", "ids", "decoded"])

    return _keyed(df, key, text, "string", run, "ids array<int>, decoded string")


def _keyed(df: DataFrame, key: str, value: str, kind: str, run, columns: str) -> DataFrame:
    key_type = df.schema[key].dataType.simpleString()
    picked = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").cast(kind).alias("value"))
    return picked.mapInArrow(run, f"key {key_type}, {columns}").withColumnRenamed("key", key)
