"""Steps that the problems on pairs share: exact-copy classes, bucket joins, both sides' texts, expansion to all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.words import pack
from textloom.session import materialize


def bucket_pairs(rows: DataFrame, key: str, node: str, least_shared: int = 1) -> DataFrame:
    """(a, b, shared): pairs a < b of nodes that meet under at least least_shared keys.

    A sort-merge join of the rows with themselves: both sides stream, a bucket
    is never gathered into a row, and adaptive execution splits skewed partitions.
    """
    left = rows.select(F.col(key).alias("k"), F.col(node).alias("a"))
    right = rows.select(F.col(key).alias("k"), F.col(node).alias("b"))
    met = left.hint("merge").join(right, "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return met.where(F.col("shared") >= least_shared) if least_shared > 1 else met


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, titles, texts = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([pack(*x) for x in zip(titles, texts)], pa.binary())], ["id", "body"])


def with_both(pairs: DataFrame, docs: DataFrame, node: str, title: str, text: str) -> DataFrame:
    """(a, b, left, right): pairs with the packed titles and texts of a's and b's rows.

    The documents that occur in a pair are picked once and written, packed, as a
    text is sent once for each of its pairs; the two joins then read only those. Their ids are written before, so that the planner knows
    their size, and are broadcast only below the session's threshold; texts, whose
    files are much smaller than they are, never are.
    """
    nodes = materialize(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct())
    own = docs.select(F.col(node).cast("long").alias("id"), F.col(title).alias("title"), F.col(text).alias("text"))
    picked = materialize(own.join(nodes, "id", "left_semi").mapInArrow(_packed, "id bigint, body binary"))
    left = picked.select(F.col("id").alias("a"), F.col("body").alias("left"))
    right = picked.select(F.col("id").alias("b"), F.col("body").alias("right"))
    return pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right")


def expand(pairs: DataFrame, members: DataFrame, within: Column | None = None) -> DataFrame:
    """Distinct (a, b), a < b, of all members of the paired classes, and of the members of one class among themselves.

    members has (id, rep) and whatever within needs; pairs has classes' representatives (a, b).
    The rows are what is asked for, so their number is the result's, not an intermediate one's.
    """
    m = members.select("id", "rep")
    across = pairs.select("a", "b").join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    own = members.where(within) if within is not None else members
    same = own.select("rep", F.col("id").alias("x")).join(own.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    return across.unionAll(same).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
