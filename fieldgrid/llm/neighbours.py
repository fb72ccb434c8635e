"""Approximate nearest neighbours by a robust-pruned directed graph for each shard.

Distinct vectors are dealt to shards by hash. Each shard's graph is built by batches of insertions: a greedy beam search
proposes neighbours, relaxed distance pruning keeps diverse edges, and reverse edges are pruned again where they are too
many. The index (vectors, keys, edges) is a written table. To search, the task that holds a shard reads all queries in blocks
from a written table, so they aren't shuffled; the nearest of all shards are ranked by exact double-precision distances.

Distances are sums of squared differences in double precision, so they hold for vectors off the origin and for tight groups; a shard's
vectors are first multiplied by a power of two, so that neither very large nor very small ones over- or underflow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from .common import scratch, written

#: Distinct vectors of a shard, most edges of a node, beam widths of building and search, pruning slack, nodes expanded a step, insertions a batch.
SHARD, DEGREE, BUILD_BEAM, SEARCH_BEAM, SLACK, EXPAND, BATCH = 9000, 28, 56, 96, 1.2, 4, 512
#: Pairs whose differences are held at a time, queries of a block.
PAIRS, BLOCK = 16_384, 256


def _scale(vectors: np.ndarray) -> float:
    """A power of two that brings the largest component to about 1; a double itself."""
    most = float(np.abs(vectors).max(initial=0.0))
    return float(2.0 ** -max(-1000, min(1000, int(np.frexp(most)[1])))) if most > 0 else 1.0


def euclidean(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distances of the query, without the over- and underflow of squares: differences are multiplied by a power of two of their own."""
    with np.errstate(over="ignore"):
        away = vectors - query
    most = np.abs(away).max(1, initial=0.0)
    power = np.where(np.isfinite(most), np.frexp(most)[1], 0)
    away = np.ldexp(away, -power[:, None])
    return np.ldexp(np.sqrt((away * away).sum(1)), power)


class Graph:
    """Vectors and their out-edges, -1 where a node has fewer. Vectors and queries are multiplied by `scale`."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, degree: int = DEGREE):
        self.scale = _scale(vectors)
        self.x = np.ascontiguousarray(vectors, np.float64) * self.scale
        self.degree = degree
        self.start = int(np.argmin(((self.x - self.x.mean(0)) ** 2).sum(1))) if len(self.x) else 0
        self.edges = np.full((len(self.x), degree), -1, np.int32) if edges is None else edges

    def distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared, of each query to its row of ids; infinite for -1."""
        out = np.full(ids.shape, np.inf)
        row, column = np.nonzero(ids >= 0)
        for i in range(0, len(row), PAIRS):
            r, c = row[i : i + PAIRS], column[i : i + PAIRS]
            away = self.x[ids[r, c]]
            away -= queries[r]
            out[r, c] = np.einsum("ij,ij->i", away, away)
        return out

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest `width` nodes that a greedy search from the start finds for each query, nearest first (-1 beyond), and their squared distances."""
        b = len(queries)
        width = min(width, len(self.x))
        ids = np.full((b, width), -1, np.int32)
        far = np.full((b, width), np.inf)
        done = np.zeros((b, width), bool)
        ids[:, 0] = self.start
        far[:, :1] = self.distances(queries, ids[:, :1])
        seen = np.zeros((b, len(self.x) + 1), bool)  # the last column is for -1
        seen[:, [self.start, -1]] = True
        live, row = np.arange(b), np.arange(b)[:, None]
        while len(live):
            waiting = np.where(done[live] | (ids[live] < 0), np.inf, far[live])
            pick = np.argsort(waiting, axis=1, kind="stable")[:, :EXPAND]
            open_ = np.isfinite(np.take_along_axis(waiting, pick, 1))
            live, pick, open_ = (a[open_.any(1)] for a in (live, pick, open_))
            if not len(live):
                break
            at = row[: len(live)]
            done[live[:, None], pick] |= open_
            nodes = np.where(open_, ids[live[:, None], pick], -1)
            near = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            d = self.distances(queries[live], near)
            all_ids, all_far = np.concatenate([ids[live], near], 1), np.concatenate([far[live], d], 1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            ids[live], far[live], done[live] = all_ids[at, best], all_far[at, best], all_done[at, best]
        return ids, far

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Of each node's candidates (-1: none) at most `degree`: the nearest first, dropping those that a kept one is nearer to by the slack."""
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == nodes[:, None]] = -1
        far = self.distances(self.x[nodes], candidates)
        by = np.argsort(far, axis=1, kind="stable")
        candidates, far = np.take_along_axis(candidates, by, 1), np.take_along_axis(far, by, 1)
        x = self.x[candidates] - self.x[nodes][:, None, :]  # seen from the node, so products cancel little
        s = (x * x).sum(2)
        between = np.maximum(s[:, :, None] + s[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0)
        alive = candidates >= 0
        out = np.full((len(nodes), self.degree), -1, np.int32)
        row = np.arange(len(nodes))
        for k in range(self.degree):
            first = np.argmax(alive, axis=1)
            some = alive[row, first]
            if not some.any():
                break
            out[some, k] = candidates[row[some], first[some]]
            alive &= ~((SLACK * SLACK * between[row, first] <= far) & some[:, None])
            alive[row, first] = False
        return out

    def build(self, width: int = BUILD_BEAM, seed: int = 0) -> Graph:
        n = len(self.x)
        if n < 2:
            return self
        turn = np.random.default_rng(seed).permutation(n).astype(np.int32)
        turn = turn[turn != self.start]
        at, size = 0, 1
        while at < len(turn):
            new = turn[at : at + size]
            found, _ = self.beam(self.x[new], width)
            self.edges[new] = self.prune(new, found)
            sources = np.repeat(new, self.degree)
            targets = self.edges[new].ravel()
            sources, targets = sources[targets >= 0], targets[targets >= 0]
            self._reverse(targets, sources)
            at += size
            size = min(BATCH, max(1, at))
        return self

    def _reverse(self, targets: np.ndarray, sources: np.ndarray) -> None:
        by = np.argsort(targets, kind="stable")
        targets, sources = targets[by], sources[by]
        nodes, first, count = np.unique(targets, return_index=True, return_counts=True)
        held = (self.edges[nodes] >= 0).sum(1)
        room = held + count <= self.degree
        of = np.repeat(np.arange(len(nodes)), count)
        place = np.arange(len(targets)) - first[of]
        free = room[of]
        self.edges[targets[free], held[of[free]] + place[free]] = sources[free]
        for lo in range(0, len(nodes), BATCH):
            full = np.flatnonzero(~room[lo : lo + BATCH]) + lo
            if len(full):
                most = int(count[full].max())
                more = np.full((len(full), most), -1, np.int32)
                slot = np.full(len(nodes), -1)
                slot[full] = np.arange(len(full))
                mine = slot[of] >= 0
                more[slot[of[mine]], place[mine]] = sources[mine]
                # Very many new edges of a hub are pruned in turns, so no matrix grows with their square.
                for i in range(0, most, 64):
                    self.edges[nodes[full]] = self.prune(nodes[full].astype(np.int32), np.concatenate([self.edges[nodes[full]], more[:, i : i + 64]], 1))


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (k, v array<double>, dim): null keys or vectors, zero vectors and those with a null or non-finite component take no part."""
    picked = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return picked.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn("dim", F.size("v"))


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: int = 11, shard: int = SHARD) -> DataFrame:
    """The written index: rows (shard, dim, i, v, keys, edges), a row for each distinct vector; keys are its `keep` smallest, which is all that a search for keep - 1 can return.

    Vectors of different lengths lie in different shards. Repeated rows count once.
    """
    valid = _valid(df, key, vector)
    # row_number() <= n is cut in every task before the exchange, so a vector that many rows share stays small.
    small = valid.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("k"))).where(F.col("n") <= keep)
    one = written(small.groupBy("v", "dim").agg(F.sort_array(F.collect_list("k")).alias("keys")), "vectors")
    sizes = one.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards"))
    dealt = one.join(sizes, "dim").withColumn("shard", F.col("dim").cast("long") * (1 << 32) + F.pmod(F.xxhash64("v"), F.col("shards")))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("keys0")
        v = np.array(table.column("v").combine_chunks().flatten().to_numpy(), np.float64).reshape(table.num_rows, -1)
        graph = Graph(v).build()
        edges = pa.array([e[e >= 0].tolist() for e in graph.edges], pa.list_(pa.int32()))
        return pa.table({"shard": table.column("shard"), "dim": table.column("dim"), "i": pa.array(np.arange(table.num_rows)), "v": table.column("v"), "keys": table.column("keys"), "edges": edges})

    rows = dealt.select("shard", "dim", "v", "keys", F.col("keys")[0].alias("keys0"))
    return written(rows.groupBy("shard").applyInArrow(build, "shard long, dim int, i long, v array<double>, keys array<long>, edges array<int>"), "graph")


def search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest keys found for each query row, without its own; ties go to the smaller key.

    A query whose beam finds fewer than k in a shard that has more compares with the whole shard, so every query has k rows or one for
    each candidate. Queries that are no valid vectors, or for whose length there is no index, have no rows. Repeated query rows
    count once. Distances beyond the range of a double are infinite.
    """
    spark = index.sparkSession
    folder = scratch(spark, "queries")
    _valid(queries, key, vector).distinct().write.parquet(folder)
    number = max(1, index.select("shard").distinct().count())
    ordered = index.repartitionByRange(number, "shard").sortWithinPartitions("shard", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for b in batches:
            own = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if held and own[lo] != shard:
                        yield from _Loaded(held).answers(folder, k, beam)
                        held = []
                    shard = own[lo]
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from _Loaded(held).answers(folder, k, beam)

    found = ordered.mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class _Loaded:
    """A shard's index in a task."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        self.v = _matrix(table.column("v").chunk(0), table.num_rows)
        self.dim = table.column("dim")[0].as_py()
        self.keys = table.column("keys").to_pylist()
        edges = np.full((table.num_rows, DEGREE), -1, np.int32)
        lists = table.column("edges").chunk(0)
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(table.num_rows), counts)
        edges[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = lists.flatten().to_numpy(zero_copy_only=False)
        self.graph = Graph(self.v, edges)

    def answers(self, folder: str, k: int, beam: int) -> Iterator[pa.RecordBatch]:
        """Answers to all written queries of the shard's length, a block at a time."""
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in ds.dataset(base, filesystem=fs, format="parquet", exclude_invalid_files=True).to_batches(batch_size=BLOCK, filter=ds.field("dim") == self.dim):
            if b.num_rows:
                yield self.answer(b, k, beam)

    def exact(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """The nearest of the whole shard, by blocks."""
        far = np.concatenate([euclidean(self.v[i : i + PAIRS], query) for i in range(0, len(self.v), PAIRS)])
        return np.argsort(far, kind="stable")[:wanted]

    def answer(self, queries: pa.RecordBatch, k: int, beam: int) -> pa.RecordBatch:
        q = _matrix(queries.column("v"), queries.num_rows)
        wanted = min(max(beam, k + 1), len(self.v))
        with np.errstate(over="ignore", invalid="ignore"):
            ids, far = self.graph.beam(q * self.graph.scale, wanted)
        out: list[tuple[int, int, float]] = []
        for own, query, near, d in zip(queries.column("k").to_pylist(), q, ids, far, strict=True):
            near = near[(near >= 0) & np.isfinite(d)]
            if len(near) < min(k + 1, len(self.v)):
                near = self.exact(query, wanted)
            rows = sorted((s, key) for s, i in zip(euclidean(self.v[near], query).tolist(), near.tolist(), strict=True) for key in self.keys[i] if key != own)[:k]
            out += [(own, key, s) for s, key in rows]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])
