"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component): component is the least id that the edges connect to id.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each is
    one grouped minimum and one join over the edges, and the number of rounds
    grows with the logarithm of the longest path. Each round's edges are written
    to the shared folder; nothing but a count comes to the driver. A node's
    neighbours are never gathered into one row, so a hub is no single task's burden.
    Self loops and nulls are ignored; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _digest(e)
    for _ in range(max_rounds):
        # large star: every larger neighbour of u, and u itself, points to the least of u's neighbourhood
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's smaller neighbours and u point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct())
        before, state = state, _digest(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)


def _digest(edges: DataFrame) -> tuple:
    """The number of edges and the sums of two hashes: equal for equal sets, in one pass."""
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total(F.xxhash64("u", "v")), total(F.xxhash64("v", "u"))).first())
