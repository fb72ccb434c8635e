import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fieldgrid.llm import decontaminate as d
from fieldgrid.llm import words
from fieldgrid.llm.queries import op4_decontamination

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(len(w) - window + 1) if len(w) > window else range(min(len(w), 1)):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    for key, t in docs:
        w = cut(t)
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= {*range(k, k + n)}
                    ids |= found
        yield key, len(w), len(hit), sorted(ids)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {k: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0 and 20 * h >= n) for k, n, h, i in brute(docs, items)}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op4_decontamination(spark, SF).collect()}
    assert got == want
    assert any(g[4] for g in got.values())


ALPHABET = st.lists(st.sampled_from(["a", "B", "c", "dd", "é", "."]), max_size=40).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(st.lists(ALPHABET, max_size=6), st.lists(ALPHABET, max_size=5), st.integers(1, 4))
def test_search_equals_brute_force(texts, items, window):
    bench = d.Benchmark([*map(str, range(len(items)))], items)
    shard = d.Shard([t.encode() for t in texts], max(bench.longest, window))
    flat = [w for t in texts for w in [*cut(t), None]]
    want_words = [w for t in items for w in cut(t)]
    length, low, high, at_low, at_high = shard.search(bench, window)
    item = [i for i, t in enumerate(items) for _ in cut(t)]
    for s in range(len(want_words)):
        end = max(k for k in range(len(item)) if item[k] == item[s]) + 1
        runs = {}
        for p in range(len(flat)):
            n = 0
            while s + n < end and p + n < len(flat) and flat[p + n] == want_words[s + n]:
                n += 1
            runs[p] = n
        best = max(runs.values(), default=0)
        assert length[s] == best
        if best:
            assert sorted(shard.suffixes[low[s] : high[s]]) == [p for p, n in runs.items() if n == best]
        need = min(window, bench.size[s])
        assert sorted(shard.suffixes[at_low[s] : at_high[s]]) == [p for p, n in runs.items() if n >= need and end - s >= need]


def test_suffix_array_of_long_repeats():
    h = np.array([5, 5, 5, 5, 3, 5, 5, 0] * 50, np.uint64)
    s = d.suffix_array(h, len(h))
    assert sorted(s.tolist()) == list(range(len(h)))
    assert s.tolist() == sorted(range(len(h)), key=lambda i: h[i:].tolist())


def test_words_equal_the_pattern():
    texts = ["Hello, wörld 42!", "", "ÄÖ a_b", "x" * 100 + " " + "x" * 101, "日本 語"]
    data, first, length, counts = words.cut([t.encode() for t in texts], words.ALPHANUMERIC)
    got = [data[a : a + n].tobytes().decode() for a, n in zip(first, length, strict=True)]
    assert got == [w for t in texts for w in cut(t)]
    assert counts.tolist() == [len(cut(t)) for t in texts]
    h = words.hashes(data, first, length)
    assert len({*h.tolist()}) == len({*got})


@pytest.mark.parametrize("blocks", [20_000, 2])
def test_odd_rows(spark, monkeypatch, blocks):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, None, "c"), (3, "", "d"), (None, text, "e"), (5, "tiny Item here", "f"), (6, text * 400, "g")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(7, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (7, "Tiny item"), (8, None), (9, "tiny item"), (None, "here"), (10, "!!")], "item_id int, text string")
    monkeypatch.setattr(d, "BLOCK_ROWS", blocks)
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in d.contamination(docs, bench).collect())
    assert rows[0] == rows[1] == ("1", 30, 14, ["7"])
    assert rows[2][1:] == rows[3][1:] == (0, 0, [])
    assert rows[4] == ("5", 3, 3, ["", "7", "9"])
    assert rows[6][1:] == (30, 14, ["7"])
    found = d.matches(docs, bench).where("doc_id = 1").collect()
    assert [(r["item"], r.item_word, r.doc_word, r.n_words) for r in found] == [("7", 0, 3, 14)] * 2
    assert d.contamination(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert d.contamination(docs.limit(0), bench).count() == 0


def test_repeated_words(spark):
    rows = [(1, "a " * 300_000), (2, "a " * 12), (3, "a b " * 2000), (4, "b " * 13)]
    items = [(1, "a " * 2000), (2, "a " * 14), (3, "b a " * 300), (4, "a"), (5, "a a a")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in d.contamination(docs, bench).collect()}
    assert got == {1: (300_000, 300_000, ["1", "2", "4", "5"]), 2: (12, 12, ["4", "5"]), 3: (4000, 4000, ["3", "4"]), 4: (13, 0, [])}
    found = d.matches(docs.where("doc_id = 4"), bench).count()
    assert found == 0
