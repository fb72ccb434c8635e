import math

import numpy as np
import pytest

from fieldgrid.llm import neighbours
from fieldgrid.llm.queries import op10_neighbours

SF = "/root/testdata/sf0.1"


def test_recall_on_the_whole_table(spark):
    got = op10_neighbours(spark, SF).collect()
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    keys = np.array([*table])
    x = np.array([*table.values()], np.float64)
    hits = total = 0
    for q in [k for k in table if k % 100 == 0]:
        d = np.sqrt(((x - np.array(table[q], np.float64)) ** 2).sum(1))
        by = [i for i in np.lexsort((keys, d)) if keys[i] != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(math.isclose(r.score, d[np.flatnonzero(keys == r.vec_id)[0]], rel_tol=1e-12) for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len({keys[i] for i in by} & {r.vec_id for r in mine})
        total += 10
    assert hits / total >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [1.0, 0.0]), *[(i, [1.0, 0.0]) for i in range(1, 40)], (50, [0.0, 1.0]), (51, None), (52, [0.0, 0.0]), (53, [None, 1.0]), (54, [float("nan"), 1.0]), (55, [float("inf"), 1.0]), (None, [1.0, 1.0]), (200, [1.0, 2.0, 3.0]), (201, [1.0, 2.0, 4.0]), (300, None)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, shard string")
    got = neighbours.search(neighbours.build_index(df), df.where("vec_id % 100 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by[0] == [(i, 0.0) for i in range(1, 11)]
    assert by[100] == [(i, 0.0) for i in range(10)]
    assert by[200] == [(201, 1.0)]
    assert set(by) == {0, 100, 200}
    empty = neighbours.build_index(df.limit(0))
    assert neighbours.search(empty, df).count() == 0
    assert neighbours.search(neighbours.build_index(df), df.limit(0)).count() == 0


def brute(x, keys, q, k=10):
    d = [math.dist(v, x[q]) for v in x]
    return [keys[i] for i in np.lexsort((keys, d)) if i != q][:k]


@pytest.mark.parametrize("change", ["as is", "+1000", "+10000", "x1e-25", "x1e20", "x1e-170", "tight groups", "mixed sizes"])
def test_recall_of_changed_vectors_over_many_shards(spark, change):
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], np.float64)
    if change.startswith("+"):
        x += float(change)
    elif change.startswith("x"):
        x *= float(change[1:])
    elif change == "tight groups":  # distances of a millionth of the vectors' length
        x = np.repeat(x[::40], 40, 0) + 1e-6 * x
    elif change == "mixed sizes":
        x[::7] *= 1e8
    keys = np.arange(len(x))
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, x, strict=True)], "vec_id long, embedding array<double>")
    index = neighbours.build_index(df, shard=300)
    assert index.select("shard").distinct().count() == 7
    got = neighbours.search(index, df.where("vec_id % 100 = 0")).collect()
    assert len(got) == 20 * 10
    hits = sum(len(set(brute(x, keys, q)) & {r.vec_id for r in got if r.query_id == q}) for q in range(0, len(x), 100))
    assert hits / 200 >= 0.9


def test_every_query_has_all_rows_there_are(spark):
    rows = [(i, [float(i % 5) * 1e300, 1e-300 * (i + 1)]) for i in range(8)] + [(100, [-1.7e308, 1.0]), (200, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(neighbours.build_index(df, shard=3), df).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {k: 9 for k, _ in rows}
