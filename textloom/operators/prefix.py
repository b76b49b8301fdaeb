"""Ordinals and running sums over groups of any size, in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.session import materialize


def prefix_sums(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name of sums, the sum of its column over the group's earlier rows in order (0 for the first).

    A window over a whole group runs in one task. Here rows are range-partitioned by
    (group, order) and written with their partition's number; each partition's sums
    are carried over to the next by a window over at most one row a group and
    partition, and within a partition a plain window suffices. A group that holds
    most rows is thus spread over many tasks. order must be total within a group
    (add a unique column); null groups are groups; group may be empty. df is written
    first, as range partitioning reads its input twice.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    names = {f"__v_{k}": v for k, v in sums.items()}
    keyed = materialize(df.withColumns(names)).repartitionByRange(*group, *order_cols).withColumn("__part", F.spark_partition_id())
    keyed = materialize(keyed)
    part_sums = keyed.groupBy(*group, "__part").agg(*(F.sum(n).alias(n) for n in names))
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = part_sums.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__part").alias("__p"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__b_{k}") for k, n in zip(sums, names)))
    on = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    local = W.partitionBy(*group, "__part").orderBy(*order_cols).rowsBetween(W.unboundedPreceding, -1)
    out = keyed.join(base, on).withColumns({k: F.col(f"__b_{k}") + F.coalesce(F.sum(f"__v_{k}").over(local), F.lit(0)) for k in sums})
    return out.drop("__part", "__p", *names, *(f"__g{i}" for i in range(len(group))), *(f"__b_{k}" for k in sums))


def ordinals(df: DataFrame, group: list[str], order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """df with the row's position in its group, from 0."""
    return prefix_sums(df, group, order, {name: F.lit(1).cast("bigint")})
