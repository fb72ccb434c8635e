"""Token ids in word-aligned binary files.

Simple-8b coding: a 64-bit word has a 4-bit selector and 60 bits of payload, and the selector says how many ids of
which width the word packs. Selector 0 is the escape: the next word holds one id of up to 64 bits as it is. Ids are
coded in blocks of BLOCK_IDS, and each block's word offset stands in the file, so that blocks are packed and unpacked
side by side by numpy, and a reader can start at any block.

A file is: the magic, six little-endian 64-bit counts (documents, ids, blocks, words, file number, part of that number),
then the arrays doc_ids, id counts of the documents, first words of the blocks, words. Files are written by the
tasks into the shared folder under a name of their own and then renamed, so a repeated task replaces its own files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import KIND, MEMO_CHARACTERS, byte_characters
from .common import list_array, scratch, slices

MAGIC = b"FGTOKS8B"
BLOCK_IDS = 512
#: Ids after which a task starts its next file (one document never spans two).
FILE_IDS = 3_000_000
#: Fixed values of the format: how many values a word packs, by selector (0: escape); each has 60 // n bits. RUNS: runs of so many ids, each two runs of the other length.
PACKED = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], np.int64)
RUNS = {1: 1, 2: 1, 3: 2, 4: 2, 5: 4, 6: 4, 7: 4, 8: 4, 10: 8, 12: 8, 15: 8, 20: 15, 30: 15, 60: 30}
BITS = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.uint8)
WIDTHS = np.array([64, *(60 // n for n in PACKED[1:15]), 64], np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids (uint64), and the first word of each block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK_IDS)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grid = np.zeros(blocks * BLOCK_IDS, np.uint64)
    grid[:n] = ids
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK_IDS, n)
    own = np.full(blocks * BLOCK_IDS, 255, np.uint8)  # bits of each id, and never too few; 255 beyond the end
    own[:n] = BITS[ids] if ids.max() < len(BITS) else np.maximum(np.frexp(ids.astype(np.float64))[1], 1)
    own = own.reshape(blocks, BLOCK_IDS)
    choice = np.concatenate([_selectors(own[i : i + 128]) for i in range(0, blocks, 128)]).ravel()
    step = np.maximum(PACKED[choice], 1)
    at, starts = np.arange(blocks) * BLOCK_IDS, []
    while len(at):  # all blocks advance by a word at a time
        starts.append(at)
        to = at + step[at]
        at = to[to < ends[at // BLOCK_IDS]]
    at = np.sort(np.concatenate(starts))
    chosen = choice[at]
    first = np.cumsum(np.where(chosen == 0, 2, 1)) - np.where(chosen == 0, 2, 1)
    words = np.zeros(int(first[-1]) + (2 if chosen[-1] == 0 else 1), np.uint64)
    for selector in range(1, 15):
        sel = np.flatnonzero(chosen == selector)
        if len(sel):
            value = np.full(len(sel), selector << 60, np.uint64)
            for k in range(int(PACKED[selector])):
                value |= grid[at[sel] + k] << np.uint64(k * int(WIDTHS[selector]))
            words[first[sel]] = value
    escaped = np.flatnonzero(chosen == 0)
    words[first[escaped] + 1] = grid[at[escaped]]
    opens = np.searchsorted(at, np.arange(blocks) * BLOCK_IDS)
    return words, first[opens]


def _selectors(own: np.ndarray) -> np.ndarray:
    """The selector of a word that starts at each id, given the bits of each id of some blocks; 0 escapes."""
    bits = np.pad(own, ((0, 0), (0, 60)), constant_values=255)
    # The most bits of the next 1, 2, ... 60 ids, each from two shorter runs; a longer run that fits overrides.
    most, best = {1: bits}, np.zeros(own.shape, np.uint8)
    for size, of in RUNS.items():
        if size > 1:
            run = most[of]
            most[size] = np.full_like(bits, 255)
            np.maximum(run[:, : of - size], run[:, size - of :], out=most[size][:, : of - size])
        selector = int(np.flatnonzero(PACKED[1:15] == size)[0]) + 1
        np.maximum(best, (most[size][:, : own.shape[1]] <= np.uint8(WIDTHS[selector])).view(np.uint8) * np.uint8(15 - selector), out=best)
    return np.where(best == 0, 0, 15 - best.astype(np.int64))


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids again, of all words or of those from any block's first word on."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    suspects = np.flatnonzero(selector == 0)
    previous = -2
    for i in suspects.tolist():  # an escape's second word may itself look like an escape
        if i - 1 != previous:
            previous = i
            raw[i + 1] = True
    count = np.where(raw, 1, np.where(selector == 0, 0, PACKED[selector]))
    to = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in range(1, 15):
        sel = np.flatnonzero((selector == s) & ~raw)
        if len(sel):
            width = int(WIDTHS[s])
            mask = np.uint64((1 << width) - 1)
            for k in range(int(PACKED[s])):
                out[to[sel] + k] = (words[sel] >> np.uint64(k * width)) & mask
    sel = np.flatnonzero(raw)
    out[to[sel]] = words[sel]
    return out


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, number: int, part: int) -> bytes:
    words, first = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(first), len(words), number, part], "<i8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), first.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def read_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """doc_ids, counts, ids, file number, part."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks, size, number, part = np.frombuffer(data, "<i8", 6, 8).tolist()
    at = 8 + 48
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<i8", docs, at + 8 * docs)
    first = np.frombuffer(data, "<i8", blocks, at + 16 * docs)
    words = np.frombuffer(data, "<u8", size, at + 16 * docs + 8 * blocks)
    ids = unpack(words)
    if len(ids) != n or counts.sum() != n:
        raise ValueError("token file is damaged")
    return doc_ids, counts, ids, number, part


def read_span(data: bytes, start: int, stop: int) -> np.ndarray:
    """The ids from place start to stop (excluded) of a file: only the blocks that hold them are unpacked."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks, size, _, _ = np.frombuffer(data, "<i8", 6, 8).tolist()
    if not 0 <= start <= stop <= n:
        raise ValueError("no such place")
    if start == stop:
        return np.zeros(0, np.uint64)
    at = 8 + 48 + 16 * docs
    first = np.append(np.frombuffer(data, "<i8", blocks, at), size)
    lo, hi = start // BLOCK_IDS, -(-stop // BLOCK_IDS)
    words = np.frombuffer(data, "<u8", int(first[hi] - first[lo]), at + 8 * blocks + 8 * int(first[lo]))
    return unpack(words)[start - lo * BLOCK_IDS : stop - lo * BLOCK_IDS]


def read_document(data: bytes, place: int) -> tuple[int, np.ndarray]:
    """Key and ids of the document at a place of a file, counted from 0."""
    docs = int.from_bytes(data[8:16], "little")
    counts = np.frombuffer(data, "<i8", docs, 56 + 8 * docs)
    start = int(counts[:place].sum())
    return int(np.frombuffer(data, "<i8", docs, 56)[place]), read_span(data, start, start + int(counts[place]))


#: Texts of these characters alone are in normal form, have no blank but ASCII's, and are lower-cased one by one.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ¡¿«»‘’“”–—…€]*")
#: On such a lower-cased text, what the pattern of bpe.KIND finds.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class Words(dict):
    """Ids of words by the library's model. When full, it begins anew, and what it held comes back as it is met again."""

    def __init__(self, model, most: int):
        self.model, self.most, self.former = model, most, {}
        self.byte = byte_characters()

    def __missing__(self, word: str) -> bytes:
        if (ids := self.former.get(word)) is None:
            spelt = word if word.isascii() else "".join([self.byte[b] for b in word.encode()])
            ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(word) <= MEMO_CHARACTERS:
            if len(self) >= self.most:
                self.former = dict(self)
                self.clear()
            self[word] = ids
        return ids


class LibraryEncoder:
    """Ids by the tokenizers library. A worker remembers the ids of words, so that each is encoded about once.

    Where the file's normalizer and pre-tokenizer are those of bpe.KIND, words of a plain text are cut here and encoded by the library's
    model, without its normalizer and pattern, which would leave them as they are. Every other text, and every text of another
    kind of file, goes through the library whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.known = all(spec[part] == value for part, value in KIND.items()) and spec["model"]["type"] == "BPE"
        self.words = Words(self.whole.model, most)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        of, out = self.words.__getitem__, []
        for t in texts:
            if not t:
                out.append(b"")
            elif self.known and _PLAIN.fullmatch(t) and not any(map(t.__contains__, self.specials)):
                out.append(b"".join(map(of, _PIECES.findall(t.lower()))))
            else:
                out.append(array("I", self.whole.encode(t, add_special_tokens=False).ids).tobytes())
        return out


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Encode the texts, append end_id, and write the files in ascending key order; the result lists the written files.

    Null text is the empty text; rows with a null key are not written (a file's keys are integers); repeated keys stand
    side by side, in the order of a hash of their texts, and may go to several files. An empty table writes no file.
    """
    picked = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    number = files or max(1, picked.rdd.getNumPartitions())
    hashed = picked.withColumn("h", F.xxhash64("t"))
    ordered = hashed.repartitionByRange(number, "k", "h").sortWithinPartitions("k", "h", "t").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        place, part = TaskContext.get().partitionId(), 0
        keys: list[np.ndarray] = []
        counts: list[int] = []
        coded: list[bytes] = []
        held = 0
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

        for b in slices(batches, 1, 4 << 20):
            some = encoder(tokenizer).encode(b.column(1).to_pylist())
            for k, c in zip(b.column(0).to_numpy(zero_copy_only=False), some, strict=True):
                keys.append(np.array([k], np.int64))
                coded += [c, tail]
                counts.append((len(c) + len(tail)) // 4)
                held += counts[-1]
                if held >= FILE_IDS:
                    yield _put(fs, base, place, part, keys, counts, coded)
                    keys, counts, coded, held, part = [], [], [], 0, part + 1
        if keys:
            yield _put(fs, base, place, part, keys, counts, coded)

    return ordered.mapInArrow(run, "path string, n_docs long, n_ids long, n_bytes long")


def _put(fs, base: str, place: int, part: int, keys: list, counts: list, coded: list) -> pa.RecordBatch:
    """Write one file under a temporary name and rename it."""
    data = file_bytes(np.concatenate(keys), np.array(counts, np.int64), np.frombuffer(b"".join(coded), "<u4"), place, part)
    name, temporary = f"{base}/tokens-{place:06d}-{part:05d}.s8b", f"{base}/.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as f:
        f.write(data)
    fs.move(temporary, name)
    return pa.RecordBatch.from_pydict({"path": [name], "n_docs": [len(counts)], "n_ids": [sum(counts)], "n_bytes": [len(data)]})


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids array<long>) of all files; start counts the ids of all documents before it in the files' order."""
    return _read(spark, folder, True)


def read_token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """As read_token_files, with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    return _read(spark, folder, False)


def _read(spark: SparkSession, folder: str, whole: bool) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.s8b").load(folder)
    last = "ids array<long>" if whole else "ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                doc_ids, counts, ids, place, part = read_bytes(content.as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                starts = ends - counts
                four = ids.astype("<u4")
                for i in range(0, len(doc_ids), 2000):
                    j = min(len(doc_ids), i + 2000)
                    if whole:
                        lo, hi = int(starts[i]), int(ends[j - 1])
                        tail = list_array(ids[lo:hi].astype(np.int64), counts[i:j], pa.int64())
                    else:
                        tail = pa.array([zlib.crc32(four[s:e]) for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)], pa.int64())
                    where = [pa.array(np.full(j - i, v, np.int64)) for v in (place, part)]
                    yield pa.RecordBatch.from_arrays([*where, pa.array(doc_ids[i:j]), pa.array(starts[i:j]), pa.array(counts[i:j]), tail], names=["place", "part", "doc_id", "first", "n_tokens", last.split()[0]])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                _, n, _, _, place, part = np.frombuffer(content.as_py(), "<i8", 6).tolist()
                yield pa.RecordBatch.from_pydict({"place": [place], "part": [part], "n": [n]})

    rows = raw.select("content").mapInArrow(run, f"place long, part long, doc_id long, first long, n_tokens long, {last}")
    heads = raw.select(F.expr("substring(content, 9, 48)").alias("head")).mapInArrow(totals, "place long, part long, n long")
    # A row for each file of millions of ids, not for each document: the one ordered sum is small.
    before = Window.orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = heads.select("place", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["place", "part"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", last.split()[0])


def token_files(df: DataFrame, tokenizer: str, folder: str | None = None, **options) -> str:
    """Write the files and return their folder."""
    spark = df.sparkSession
    folder = folder or scratch(spark, "tokens")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    write_token_files(df, folder, tokenizer, **options).agg(F.sum("n_ids")).collect()
    return folder
