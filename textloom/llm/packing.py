"""Problem 7: items of varying length into containers of fixed capacity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bpe import BYTE_BPE_50K
from textloom.llm.tokencount import token_counts
from textloom.session import materialize

CAPACITY = 4096


class SumOfSquares:
    """Online packing (Csirik et al., 2006): an item goes to the fill level that makes the sum, over all levels, of the squared numbers of containers at that level least.

    open[h] is the number of containers filled to h, stack[h] holds them. Ties go to
    the fullest container, so that a container is closed where possible.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.open = np.zeros(capacity + 1, np.int64)
        self.stack: list[list[int]] = [[] for _ in range(capacity)]

    def place(self, size: int) -> int:
        """The container of an item of 1 to capacity units."""
        top = self.capacity - size
        # moving one container from level h to h + size changes the sum by 2 * (open[h + size] - open[h] + 1); a full one counts nowhere
        change = self.open[size : self.capacity + 1] - self.open[: top + 1] + 1
        change[top] = -self.open[top] if top else 0
        fits = self.open[: top + 1] > 0
        fits[0] = True
        change[0] = self.open[size] if top else 0
        change = np.where(fits, 2 * change + 1, np.iinfo(np.int64).max)
        h = top - int(np.argmin(change[::-1]))
        if h:
            self.open[h] -= 1
            at = self.stack[h].pop()
        else:
            at = self.made
            self.made += 1
        if h + size < self.capacity:
            self.open[h + size] += 1
            self.stack[h + size].append(at)
        return at


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int64()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("container_id", pa.int64())])


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("turn", "ascending"), ("doc_id", "ascending"), ("n_tokens", "ascending")])
        shard = group.column("shard")[0].as_py() if group.num_rows else 0
        packer, rows = SumOfSquares(capacity), []
        for doc, n in zip(group.column("doc_id").to_pylist(), group.column("n_tokens").to_pylist()):
            for piece, start in enumerate(range(0, n, capacity)):
                size = min(capacity, n - start)
                rows.append((doc, piece, start, size, shard << 32 | packer.place(size)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, _SCHEMA)], schema=_SCHEMA)

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard_docs: int = 20_000, path: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container_id): each document's place.

    A document of more than capacity tokens is cut into full pieces and a rest; no
    other is split. Sizes are counted once and written. Documents are spread by the
    hash of their id over shards of about shard_docs, each packed by itself, in a
    task of its own, in the order of that hash: a few open containers a shard are
    the price for packing all shards at once. Documents without tokens (null, empty)
    come out once, with piece 0 of 0 tokens and null container_id. Rows with the
    same id are packed as separate items.
    """
    counted = materialize(token_counts(docs, text, doc_id, path=path).select(F.col(doc_id).cast("long").alias("doc_id"), "n_tokens"))
    shards = max(1, -(-counted.count() // shard_docs))
    turn = F.xxhash64("doc_id")
    sharded = counted.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens", turn.alias("turn"), F.pmod(turn, F.lit(shards)).cast("int").alias("shard"))
    # a partition a shard: packing takes long for the bytes it reads, so shards must not be merged by size
    packed = sharded.repartitionById(shards, "shard").groupBy("shard").applyInArrow(_pack(capacity), "doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint, container_id bigint")
    zero = F.lit(0).cast("long")
    bare = counted.where("n_tokens = 0").select("doc_id", zero.alias("piece_no"), zero.alias("start_token"), zero.alias("n_tokens"), F.lit(None).cast("long").alias("container_id"))
    return packed.unionAll(bare)


def split_items(packed: DataFrame) -> DataFrame:
    """(doc_id): the documents that had to be split."""
    return packed.where(F.col("piece_no") == 1).select("doc_id").distinct()


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: number of items, containers, tokens and the share of room left unused; and the fewest containers that could hold the tokens."""
    used = packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    total = F.coalesce(F.sum("tokens"), F.lit(0))
    return used.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"), F.count("*").alias("n_containers"), total.alias("n_tokens"),
        F.ceil(total / capacity).alias("least_containers"), F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"), (1 - F.try_divide(total, F.count("*") * capacity)).alias("unused_share"),
    )
