"""Connected components of written edge tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): the smallest node that each node of an edge reaches; nulls and loops link nothing.

    Large stars tie each node's larger neighbours to its smallest, small stars its smaller ones; both keep the components,
    and in a logarithmic number of rounds each is one star. Neighbours are never gathered: a minimum for each node is
    joined to the edges, so a hub costs rows in proportion to its edges, and partial minima come before the exchange.
    Every round is written to the shared folder.
    """
    now = written(_tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(_tidy(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "edges")
        # Edges run from the larger node, a, to the smaller, b.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = written(_tidy(tied), "edges")
        if (new := _mark(now)) == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct()).distinct()


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
