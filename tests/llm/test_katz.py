import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fieldgrid.llm import katz
from fieldgrid.llm.queries import op2_katz

SF = "/root/testdata/sf0.001"


def cut(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def by_hand(values, k=5):
    """Katz's discounts of counts 1..k by Good-Turing, as they are or by a line through all counts up to 41; None where neither gives shares."""
    n = {r: c for r, c in Counter(values).items() if r <= 41}

    def shares(n):
        if not n.get(1):
            return None
        a = (k + 1) * n.get(k + 1, 0) / n[1]
        d = []
        for r in range(1, k + 1):
            if not n.get(r) or a == 1:
                return None
            d.append(((r + 1) * n.get(r + 1, 0) / (r * n[r]) - a) / (1 - a))
        return dict(enumerate(d, 1)) if all(0 < x < 1 for x in d) else None

    if not n.get(1) or (d := shares(n)):
        return d if n.get(1) else None
    rs = sorted(n)
    if len(rs) < 3:
        return None
    z = [2 * n[r] / ((rs[i + 1] if i + 1 < len(rs) else 2 * r - rs[i - 1]) - (rs[i - 1] if i else 0)) for i, r in enumerate(rs)]
    xs, ys = [math.log(r) for r in rs], [math.log(v) for v in z]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
    return shares({r: math.exp(my + slope * (math.log(r) - mx)) for r in range(1, k + 2)}) if slope < -1 else None


def absolute(values, k=5):
    n1, n2 = sum(v == 1 for v in values), sum(v == 2 for v in values)
    if not n1:
        return {r: 1.0 for r in range(1, k + 1)}
    return {r: 1 - (n1 / (n1 + 2 * n2) if n2 else 0.5) / r for r in range(1, k + 1)}


def katz_by_hand(train):
    """p(word, context) of dictionaries of counts."""
    uni, bi = Counter(), defaultdict(Counter)
    for t in train:
        last = None
        for w in cut(t):
            uni[w] += 1
            bi[last][w] += 1
            last = w
    total = sum(uni.values())
    words = by_hand([*uni.values()]) or absolute([*uni.values()])
    pairs = [v for b in bi.values() for v in b.values()]
    share = by_hand(pairs) or absolute(pairs)
    put_aside = sum((1 - words[c]) * c for c in uni.values() if c <= 5)
    unknown = put_aside / total if put_aside > 0 else 0.5 / (total + 0.5)

    def one(w):
        c = uni.get(w, 0)
        if not c:
            return unknown
        return words.get(c, 1) * c / total * (1 if put_aside > 0 else total / (total + 0.5))

    @cache
    def followers(context):
        seen = bi[context]
        size = sum(seen.values())
        kept = {v: share.get(c, 1) * c / size for v, c in seen.items()}
        left = 1 - sum(kept.values())
        if left < 1e-12:
            kept = {v: k * size / (size + 0.5) for v, k in kept.items()}
            left = 0.5 / (size + 0.5)
        return kept, left / (1 - sum(map(one, seen)))

    def p(w, context):
        if context not in bi:
            return one(w)
        kept, back = followers(context)
        return kept[w] if w in kept else back * one(w)

    return p, uni, total, bi


def check(rows, docs, train):
    p, uni, total, bi = katz_by_hand([t for k, t in docs if train(k)])
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for k, t in docs:
        w = cut(t)
        r = by[k][0]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train(k), len(w), sum(x in uni for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((uni.get(x, 0) + 0.5) / (total + 0.5 * (len(uni) + 1))) for x in w), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r.score, sum(math.log10(p(x, c)) for x, c in zip(w, [None, *w], strict=False)), rel_tol=1e-9, abs_tol=1e-9)
    return p, uni, bi


@pytest.mark.parametrize("small", [False, True])
def test_whole_table(spark, monkeypatch, small):
    SF = "/root/testdata/sf0.001" if small else "/root/testdata/sf0.01"  # noqa: N806
    if small:  # many chunks and owners, and frequent contexts that are dealt by both words
        for name, n in (("CHUNK_BYTES", 20_000), ("OWNED_WORDS", 2000), ("OWNED_BIGRAMS", 4000)):
            monkeypatch.setattr(katz, name, n)
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op2_katz(spark, SF).withColumn("train", ~F.col("held_out")).collect()
    p, uni, bi = check(rows, docs, lambda k: not held(k))
    for context in [None, *sorted((w for w in bi if w), key=lambda w: -uni[w])[:3], *sorted((w for w in bi if w), key=lambda w: uni[w])[:3]]:
        assert math.isclose(sum(p(w, context) for w in uni) + p("never seen", context), 1, rel_tol=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_odd_rows(spark):
    docs = [(1, "a b a b a c"), (2, None), (3, ""), (4, "a z Z"), (5, " \t\n"), (None, "b b")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, chunk string, score int")
    check(katz.score(df, F.col("doc_id") != 4).collect(), docs, lambda k: k != 4)
    assert all(r.score == 0 and r.train_tokens == 0 and r.base_score == 0 for r in katz.score(df, F.lit(False)).collect())
    assert katz.score(df.limit(0), F.lit(True)).count() == 0
    twice = katz.score(df.union(df), F.lit(True)).collect()
    assert len(twice) == 12


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**63)), max_size=50))
def test_squeeze(a):
    assert katz.spread(katz.squeeze(np.array(a, np.uint64))).tolist() == a
    assert katz.spread(katz.squeeze(np.array(a, np.float64))).tolist() == [float(x) for x in a]


def test_discounts_are_turings_at_every_scale(spark, tmp_path):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        model = katz.fit(docs, ~(F.crc32(F.col("doc_id").cast("string")) % 5 == 1))
        assert "absolute" not in model.discounting, sf
    assert katz.discounts(np.array([0, 100, 40, 20, 12, 8, 6]))[1] == "counts"
    assert katz.discounts(np.array([0, 100, 40, 20, 12, 30, 6, 4, 3]))[1] == "fit"
    for coc in ([0, 1], [0, 0, 5], [], [0, 5, 5]):
        share, how = katz.discounts(np.array(coc))
        assert how == "absolute" and (share > 0).all() and (share <= 1).all()


def test_a_stored_model_scores_other_texts(spark, tmp_path, monkeypatch):
    for name, n in (("CHUNK_BYTES", 20_000), ("OWNED_WORDS", 2000), ("OWNED_BIGRAMS", 4000)):
        monkeypatch.setattr(katz, name, n)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = ~(F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    want = {r.doc_id: r for r in katz.score(docs, train).collect()}
    katz.fit(docs, train).save(f"file://{tmp_path}/model")
    model = katz.load(spark, f"file://{tmp_path}/model")
    got = katz.score_by(model, docs).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert not r.train and (r.n_tokens, r.n_known, r.train_tokens) == (w.n_tokens, w.n_known, w.train_tokens)
        assert math.isclose(r.score, w.score, rel_tol=1e-12) and math.isclose(r.base_score, w.base_score, rel_tol=1e-12)
    new = spark.createDataFrame([(1, "never seen words only zzzz"), (2, None), (3, ""), (4, "x " * 50_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in katz.score_by(model, new).collect()} == {1: 6, 2: 1, 3: 1, 4: 50_001}
    assert katz.score_by(model, new.limit(0)).count() == 0
