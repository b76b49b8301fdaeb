"""Overlapping token windows with padding, masks and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_count(tokens: Column, content: int, overlap: int) -> Column:
    """How many windows of content tokens, each sharing overlap with the one before, cover so many tokens; 1 for none."""
    return F.when(tokens <= content, F.lit(1).cast("bigint")).otherwise(1 + F.ceil((tokens - content) / F.lit(float(content - overlap))))


def sliding_windows(df: DataFrame, tokens: str, max_length: int = 512, overlap: int = 380, specials: int = 1, name: str = "win", out: str = "window_tokens") -> DataFrame:
    """df with one row a window: its number and its tokens, special tokens not included.

    overlap is what neighbours share, not the step; the content is max_length less
    the special tokens. A short or empty sequence has one window. Null tokens have none.
    """
    content = max_length - specials
    if not 0 <= overlap < content:
        raise ValueError("overlap must be less than max_length without the special tokens")
    size = F.array_size(tokens).cast("bigint")
    # explode would make the optimizer filter by the sequence first, and compute the tokens once more for that
    numbered = df.withColumn(name, F.explode_outer(F.sequence(F.lit(0).cast("bigint"), window_count(size, content, overlap) - 1))).where(F.col(name).isNotNull())
    return numbered.withColumn(out, F.slice(tokens, (F.col(name) * (content - overlap) + 1).cast("int"), content))


def padded(tokens: Column, max_length: int, pad, first=None) -> tuple[Column, Column, Column]:
    """(input_ids, attention_mask, labels): the optional first token and the tokens, filled up with pad on the right; labels repeat input_ids, padding included."""
    ids = tokens if first is None else F.concat(F.array(F.lit(first)), tokens)
    room = F.greatest(F.lit(max_length) - F.size(ids), F.lit(0))
    filled = F.concat(ids, F.array_repeat(F.lit(pad), room))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), room))
    return filled, mask, filled


def prompt_split(df: DataFrame, ids: str, mask: str, batch: str, order: str, samples: int = 2, pad: int | None = None, prompt_length: int | None = None) -> DataFrame:
    """The first samples rows of each batch with prompt and ground_truth: cut after half the real tokens of the batch's first row, padding removed from the latter. With prompt_length the cut comes after so many tokens instead, or at the row's end.

    Only order keys and lengths are grouped; the arrays of the rows that they name
    are joined back. order must be unique within a batch, whose size is fixed.
    """
    size = F.size(ids) if prompt_length is not None else F.aggregate(mask, F.lit(0).cast("bigint"), lambda s, x: s + x)
    keys = df.select(batch, order, size.cast("bigint").alias("__size")).groupBy(batch).agg(F.slice(F.array_sort(F.collect_list(order)), 1, samples).alias("__first"), F.min(F.struct(order, "__size")).alias("__head"))
    half = F.floor(F.col("__head.__size") / 2) if prompt_length is None else F.least(F.lit(prompt_length), F.col("__head.__size"))
    asked = keys.select(F.col(batch).alias("__batch"), half.cast("int").alias("half"), F.explode("__first").alias("__order"))
    rows = df.join(asked, F.col(batch).eqNullSafe(F.col("__batch")) & (F.col(order) == F.col("__order")))
    truth = F.slice(ids, F.col("half") + 1, F.greatest(F.size(ids) - F.col("half"), F.lit(0)))
    return rows.select(batch, order, F.slice(ids, 1, F.col("half")).alias("prompt"), (truth if pad is None else F.array_remove(truth, pad)).alias("ground_truth"))
