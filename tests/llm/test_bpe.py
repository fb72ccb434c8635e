import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldgrid.llm import bpe, token_files
from fieldgrid.llm.queries import op1_bpe, op5_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t", "Hello, World! it's 1234", "a\x1cb \x1d c", "x<|endoftext|>y <|startoftext|>", "ÉÀ é İΣΑΣ ﬁ", "日本語 テスト 🙂🙂", "a" * 5000, " wide space　", "don't WE'LL 'S"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_heap_merges_equal_the_library(library):
    own = bpe.Bpe(PATH)
    for text in ODD[1:]:
        assert np.frombuffer(own.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    lib, own = Tokenizer.from_file(PATH) if not hasattr(test_any_text_equals_the_library, "lib") else test_any_text_equals_the_library.lib, bpe.model(PATH)
    test_any_text_equals_the_library.lib = lib
    if any(ord(c) > 0xFFFF for c in text):  # characters of newer Unicode versions may differ in class
        text = "".join(c for c in text if ord(c) <= 0xFFFF and c.isascii() or c.isalpha() and ord(c) < 0x250)
    text = "".join(c for c in text if ord(c) < 0x250)
    assert np.frombuffer(own.encode(text), "<i4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_op1_whole_table(spark, library):
    rows = {r.doc_id: r for r in op1_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_odd_rows_and_clashing_columns(spark, library):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(ODD)] + [(3, ODD[3], "x", [1]), (None, "null key", "x", [1])], "doc_id long, text string, key string, ids array<int>")
    rows = bpe.round_trip(df, PATH).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = "null key" if r.doc_id is None else ODD[r.doc_id] or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in again) == sorted((str(r.doc_id), r.decoded) for r in rows)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    words, first = token_files.pack(a)
    assert token_files.unpack(words).tolist() == ids
    assert len(first) == -(-len(ids) // token_files.BLOCK_IDS)
    for b in range(len(first)):  # every block can be read alone
        end = first[b + 1] if b + 1 < len(first) else len(words)
        assert token_files.unpack(words[first[b] : end]).tolist() == ids[b * token_files.BLOCK_IDS : (b + 1) * token_files.BLOCK_IDS]


def test_op5_whole_table(spark, library):
    rows = {r.doc_id: r for r in op5_token_files(spark, SF).collect()}
    start = 0
    for d in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id):
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [1]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_library_encoder_by_chunks(library):
    texts = [*ODD, "don't. wörld! ÉCOLE; İx İ.. a'b ... !? x<|ENDOFTEXT|> <|endoftext|>.", "e\u0301te\u0301 Ae\u0301, ΣΑΣ. ǅ 12,5 x1.", "L'École d'été: «¿Qué?» it's we'll I'D 'ſ 3.14 a_b ÀÖØÞß÷×ÿ"]
    for most in (3, 100_000):
        e = token_files.LibraryEncoder(PATH, most)
        for _ in range(2):
            for t in texts:
                assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_token_files_odd_rows(spark, library, tmp_path):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "y"), (None, "gone", "z")], "doc_id long, text string, start string")
    folder = token_files.token_files(df, PATH, f"file://{tmp_path}/a", files=3)
    rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([*range(len(ODD)), 3])
    assert all(r.ids == library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids + [1] for r in rows)
    empty = token_files.token_files(df.limit(0), PATH, f"file://{tmp_path}/b")
    assert token_files.read_token_files(spark, empty).count() == 0


def test_sha_of_empty_ids(spark):
    assert spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), " "), 256).alias("s")).first().s == hashlib.sha256(b"").hexdigest()


def test_parts_of_files_by_offset(library):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 900, 40)
    ids = np.where(rng.random(counts.sum()) < 0.01, 2**40, rng.integers(0, 50_000, counts.sum())).astype(np.uint64)
    data = token_files.file_bytes(np.arange(40) * 7, counts, ids, 0, 0)
    for start, stop in [(0, 0), (0, len(ids)), (511, 513), (512, 1024), (5000, 5001), (len(ids) - 1, len(ids))]:
        assert token_files.read_span(data, start, stop).tolist() == ids[start:stop].tolist()
    ends = counts.cumsum()
    for place in (0, 17, 39):
        key, own = token_files.read_document(data, place)
        assert key == place * 7 and own.tolist() == ids[ends[place] - counts[place] : ends[place]].tolist()
    with pytest.raises(ValueError):
        token_files.read_span(data, 0, len(ids) + 1)


def test_other_kinds_of_tokenizer_files(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()  # no lower case
    (tmp_path / "t.json").write_text(json.dumps(spec))
    for path in (str(tmp_path / "t.json"), public_tokenizers.path("byte_bpe_50k.json")):
        lib = Tokenizer.from_file(path)
        for t in ("Hello World", "it's 12 Ärger"):
            assert np.frombuffer(token_files.LibraryEncoder(path).encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        with pytest.raises(ValueError):
            bpe.Bpe(path)


def test_memos_leave_long_words_out(library):
    own, other = bpe.Bpe(PATH), token_files.LibraryEncoder(PATH)
    texts = ["ab" * 5000, "short words", "x-" * 4000]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<i4").tolist() == np.frombuffer(other.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert max(map(len, [*own.memo, *own.words, *other.words])) <= bpe.MEMO_CHARACTERS


def test_repeated_keys_spread(spark, library, tmp_path):
    df = spark.createDataFrame([(7, f"text number {i}") for i in range(300)] + [(1, "first"), (9, "last")], "doc_id long, text string")
    folder = token_files.token_files(df, PATH, f"file://{tmp_path}/c", files=4)
    rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, *[7] * 300, 9]
    assert len(list((tmp_path / "c").glob("*.s8b"))) == 4
