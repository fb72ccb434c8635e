import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from fieldgrid.llm import audit

SCHEMA = "part string, source string, doc_id long, text string, mask string, h string, possible int, k int"


def failed(text, first):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if first else "")


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic). Every filter is applied, document by document."""
    rows = []
    for k, t, s in docs:
        ids = [x for x, u, _ in docs if (u or "") == (t or "") and x is not None]
        fails = failed(t or "", k is not None and k > min(ids))
        known = [x for x in labels if x[0] is not None and x[0] == k]
        rows.append((s or "", fails, any(q == 1 for _, q, _ in known), any(x == 1 for _, _, x in known)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                fails = [r for r in own if f in r[1]]
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def shown(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def odd(spark):
    long = " ".join(f"word{i}" for i in range(40_000))
    texts = [None, "", long, long, "A B C", "a b c", "cost 5$ & more", "cost 5$ & more", "x " * 300, "x " * 300, "\x00é " * 250, long.upper(), *["same again"] * 30]
    docs = [(i // 2 if i != 3 else None, t, [None, "", "a", "b"][i % 4]) for i, t in enumerate(texts)]
    labels = [(0, 1, 0), (0, 1, 1), (2, 0, 1), (None, 1, 1), (5, None, 1), (6, 1, None), (7, 1, 0), (99, 1, 1)]
    rows = [("x", s, k, t, "m", "h", 1, 2) for k, t, s in docs]
    return docs, labels, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("most", [audit.WORKER_BYTES, 0])
def test_odd_rows_both_ways_of_asking(spark, most):
    docs, labels, df, known = odd(spark)
    got = shown(audit.audit(df, known, most=most))
    assert got == brute(docs, labels) and len(got) == 3 * 600
    assert audit.audit(df.limit(0), known, most=most).count() == 0
    assert shown(audit.audit(df, known.limit(0)))["a", "ABCDE", 1][4:6] == (0, 0)


def test_texts_with_one_hash_stay_apart(spark):
    rows = spark.createDataFrame([(k, "p", 0, 7, True, t) for k, t in [(1, "x"), (2, "y"), (3, "x"), (4, "y"), (4, "z"), (None, "x"), (5, "w")]], "k long, part string, mask int, h long, possible boolean, text string")
    assert sorted(r.k for r in audit.later_copies(rows).collect()) == [3, 4]


def test_sketch_misses_no_copy_and_clears_most_others(spark):
    """Several segments, hashes from very many rows: all repeated ones are possible, one in a hundred others at most."""
    n = 300_000
    df = spark.range(n).select(F.xxhash64(F.col("id") % (n - 1000)).alias("h"), (F.col("id") % (n - 1000) < 1000).alias("twice")).repartition(4)
    for most in (audit.WORKER_BYTES, 0):
        found = {(r.twice, r.possible): r["count"] for r in audit.possible_repeats(df, n, most).groupBy("twice", "possible").count().collect()}
        assert found[True, True] == 2000 and (True, False) not in found
        assert found.get((False, True), 0) < n // 100


def test_other_filters(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "b c", "s")], "doc_id long, text string, source string")
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = shown(audit.audit(df, known, {"W": "n_words < 2"}, "X"))
    assert got == {("s", "WX", 1): (1, 2, 0, 1, 0, 0, 3), ("s", "WX", 2): (1, 0, 1, 0, 0, 0, 1), ("s", "XW", 1): (2, 1, 0, 0, 0, 0, 1), ("s", "XW", 2): (1, 1, 1, 1, 0, 0, 3)}
    with pytest.raises(ValueError):
        audit.audit(df, known, {c: "true" for c in "ABCDFG"})
