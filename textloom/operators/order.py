"""Seeded permutations, exact splits, shards and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.session import materialize


def turn(seed: int, *ids: str) -> Column:
    """The key whose order is the permutation of a seed: a digest of seed and ids, the same in any engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(c).cast("string") for c in ids)))


def _in_turn(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    """df written with the permutation's key."""
    return materialize(df.withColumn("__turn", turn(seed, *ids)))


def _digits(n: int, rows: int = 1 << 20) -> int:
    """How many hexadecimal digits make buckets of about rows rows at most: three for up to 4 billion rows, and more as there are more."""
    digits = 3
    while n > rows << 4 * digits:
        digits += 1
    return digits


def _positions(keyed: DataFrame, ids: list[str], name: str, n: int) -> DataFrame:
    """The rows' places in the order of their keys. Keys are uniform, so their first digits make even buckets: bucket sizes are summed up in one small table and rows are numbered within their buckets, all buckets at once."""
    bucket = F.left("__turn", F.lit(_digits(n)))
    sizes = keyed.groupBy(bucket.alias("__b")).agg(F.count("*").alias("__n"))
    starts = sizes.select("__b", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    rank = F.row_number().over(W.partitionBy("__b").orderBy("__turn", *ids))
    placed = keyed.withColumn("__b", bucket).join(F.broadcast(starts), "__b")  # at most 4,096 rows, or one for each 65,536 of the table
    return placed.withColumn(name, (F.col("__start") + rank - 1).cast("bigint")).drop("__turn", "__b", "__start")


def permuted(df: DataFrame, ids: list[str], seed: int, name: str = "pos") -> DataFrame:
    """df with each row's position, from 0, in the seed's permutation. ids must be unique together."""
    keyed = _in_turn(df, ids, seed)
    return _positions(keyed, ids, name, keyed.count())


def split_share(df: DataFrame, ids: list[str], seed: int, share: float = 0.9, name: str = "split") -> DataFrame:
    """df with split 'train' for exactly floor(share * n) rows of the permutation, else 'val'. The complement needs no join."""
    keyed = _in_turn(df, ids, seed)
    n = keyed.count()
    return _positions(keyed, ids, "__pos", n).withColumn(name, F.when(F.col("__pos") < int(share * n), "train").otherwise("val")).drop("__pos")


def split_documents(df: DataFrame, doc: str, seed: int, share: float = 0.9, name: str = "split") -> DataFrame:
    """df with whole documents split by share, so that windows of one document, which overlap, never stand in both splits."""
    documents = split_share(df.select(doc).distinct(), [doc], seed, share, name)
    return df.join(documents, doc)


def split_fixed(df: DataFrame, ids: list[str], seed: int, test_size: int = 2, name: str = "split") -> DataFrame:
    """df with split 'test' for the first test_size rows of the permutation, else 'train'."""
    return permuted(df, ids, seed, "__pos").withColumn(name, F.when(F.col("__pos") < test_size, "test").otherwise("train")).drop("__pos")


def shards(df: DataFrame, world: int, batch: int, position: str = "pos", drop_last: bool = False) -> DataFrame:
    """Rows with rank, local position and batch; position counts from 0 in the order wanted.

    So that every rank gets as many, the first rows are repeated at the end, again and
    again if there are fewer rows than ranks. With drop_last the surplus rows are left out instead.
    """
    n = df.count()
    if drop_last:
        full = n // world * world
        spread = df.where(F.col(position) < full).withColumn("__p", F.col(position))
    else:
        size = -(-n // world) * world if n else 0
        last = F.lit(size - 1) - F.pmod(F.lit(size - 1) - F.col(position), F.lit(max(n, 1)))
        spread = df.withColumn("__p", F.explode(F.sequence(F.col(position), last.cast("bigint"), F.lit(max(n, 1)).cast("bigint"))))
    local = F.floor(F.col("__p") / world)
    return spread.withColumns({"shard_pos": F.col("__p").cast("bigint"), "rank": F.pmod(F.col("__p"), F.lit(world)).cast("bigint"), "batch": F.floor(local / batch).cast("bigint")}).drop("__p")


def collate(sharded: DataFrame, *columns: str) -> DataFrame:
    """(rank, batch, ...): a batch's columns stacked in the order of positions. A batch's size is fixed, so its group is bounded."""
    rows = F.array_sort(F.collect_list(F.struct("shard_pos", *columns)))
    stacked = sharded.groupBy("rank", "batch").agg(rows.alias("__rows"))
    return stacked.select("rank", "batch", *(F.col(f"__rows.{c}").alias(c) for c in columns))


def rank_scope(sharded: DataFrame, scope: str = "global") -> DataFrame:
    """The rows that metrics are taken of: all ranks' ('global'), or the first rank's shard only ('rank0')."""
    if scope not in ("global", "rank0"):
        raise ValueError(f"unknown scope {scope}")
    return sharded.where(F.col("rank") == 0) if scope == "rank0" else sharded


def leads(rank: Column) -> Column:
    """Whether a process writes and logs: the first rank, or the only one (null)."""
    return F.coalesce(rank == 0, F.lit(True))
