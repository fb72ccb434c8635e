import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from fieldgrid.llm import simhash
from fieldgrid.operators.components import components
from fieldgrid.llm.queries import op8_simhash

SF = "/root/testdata/sf0.01"


def one(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(keys, fps, radius=2):
    at = list(range(len(fps)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius).tolist():
            x, y = find(i), find(j)
            at[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i in range(len(a)):
        members[find(i)].append(keys[i])
    return {k: min(v) for v in members.values() for k in v}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in op8_simhash(spark, SF).collect()}
    fps = [one(d.text) for d in docs]
    want = roots([d.doc_id for d in docs], fps)
    assert len(got) == len(docs)
    for d, f in zip(docs, fps, strict=True):
        assert got[d.doc_id].fingerprint == f"{f:016x}" and got[d.doc_id].component_id == want[d.doc_id]
    assert len({*want.values()}) < len(docs)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\t\n\x85", max_size=40), min_size=1, max_size=8))
def test_fingerprints(texts):
    assert simhash.fingerprints(texts).tolist() == [one(t) for t in texts]


def test_long_text():
    t = " ".join(f"w{i % 997}" for i in range(3000))
    assert simhash.fingerprints([t, None, t]).tolist() == [one(t), 0, one(t)]


def clustered(n, rng):
    base = rng.integers(0, 2**63, n // 4, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 2)).astype(np.uint64)
    return np.unique(rng.choice(base, n) ^ flips[:, 0] ^ flips[:, 1])


def test_every_pair_meets_once_and_the_forest_spans():
    rng = np.random.default_rng(1)
    fps = clustered(3000, rng)
    for radius in (0, 2, 3):
        tree = simhash.Tree(fps[::3], 4)
        index, leaf, home = tree.deal(fps, radius)
        assert sorted(index[home].tolist()) == list(range(len(fps)))
        a, b = [], []
        for x in np.unique(leaf):
            p, q = simhash.links(fps[index[leaf == x]], home[leaf == x], radius)
            a, b = [*a, *p.tolist()], [*b, *q.tolist()]
        want = roots(list(range(len(fps))), fps.tolist(), radius)
        at = {f: f for f in fps.tolist()}

        def find(i, at=at):
            while at[i] != i:
                i = at[i]
            return i

        for x, y in zip(a, b, strict=True):
            x, y = find(x), find(y)
            at[max(x, y)] = min(x, y)
        got = [find(f) for f in fps.tolist()]
        assert len({*zip(got, (want[i] for i in range(len(fps))), strict=True)}) == len({*got}) == len({*want.values()})


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    at = {x: x for p in pairs for x in p}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(4, None, 1), (2, "", 1), (9, " \n", 1), (None, "one two three four", 1), (7, "One two  three four", 1), (7, "one two three four", 1), (3, "other words entirely here", 1)], "doc_id long, text string, fp int")
    rows = sorted((str(r.doc_id), r.component_id) for r in simhash.groups(simhash.fingerprint(df)).collect())
    assert rows == [("2", 2), ("3", 3), ("4", 2), ("7", 7), ("7", 7), ("9", 2), ("None", 7)]
    assert simhash.groups(simhash.fingerprint(df.limit(0))).count() == 0


def test_keep_one_by_row(spark):
    copy = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(3, copy), (None, copy), (None, "a text of its own without any key"), (5, copy), (5, "the other row of five is unlike all others"), (7, "seven stands alone here"), (None, None), (8, ""), (None, "words that two rows without key have"), (None, "words that two rows without key have")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, simhash.keep_one(df).collect()))
    assert got == sorted(map(str, (df.where("text <> ''").filter(f"NOT (text = '{copy}' AND NOT doc_id <=> 3)").collect() + df.where("doc_id = 8").collect())))


@pytest.mark.parametrize("levels", [1, 12])
def test_blocks_of_large_leaves(spark, monkeypatch, levels):
    for name, n in (("LEAF", 40), ("LEVELS", levels), ("SAMPLE", 200)):
        monkeypatch.setattr(simhash, name, n)
    fps = clustered(3000, np.random.default_rng(4))
    df = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.view(np.int64).tolist())], "doc_id long, fp long")
    want = roots(list(range(len(fps))), fps.tolist())
    assert {r.doc_id: r.component_id for r in simhash.groups(df).collect()} == want


def test_keep_one_of_clashing_columns(spark):
    copy = "the quick brown fox jumps over the lazy dog and runs away"
    df = spark.createDataFrame([(3, copy, "x", 1, 2), (5, copy, "y", 1, 2), (6, "another text", "z", 3, None)], "doc_id long, text string, gone string, gone_hash int, fp int")
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.where("doc_id <> 5").collect()))
