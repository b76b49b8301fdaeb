"""Which checkpoints are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PREFIX = "checkpoint"


def retained(manifest: DataFrame, keep: int, run: list[str] = [], file: str = "file_name", numeric: bool = False) -> DataFrame:  # noqa: B006
    """manifest with kept: the last keep files of each run whose name starts with PREFIX, in the order of their names (as text; numeric orders by the first number in them). Other files are kept, and keep 0 deletes nothing. Rows written twice share their file's fate."""
    by = F.regexp_extract(file, r"(\d+)", 1).try_cast("bigint") if numeric else F.col(file)
    counted = F.startswith(F.col(file), F.lit(PREFIX))
    rank = F.dense_rank().over(W.partitionBy(*run, counted).orderBy(by.desc(), F.col(file).desc()))
    return manifest.withColumn("kept", ~counted | F.lit(keep == 0) | (rank <= keep))


def checkpoint_name(epoch: Column, is_best: Column) -> Column:
    return F.when(is_best, "best_model.pt").otherwise(F.format_string("checkpoint_epoch_%d.pt", epoch + 1))


def resume_position(manifest: DataFrame, run: list[str], epoch: str = "epoch") -> DataFrame:
    """(run, epochs_run): the epoch at which each run goes on after its last checkpoint. Steps and the best loss start anew."""
    return manifest.groupBy(*run).agg((F.max(epoch) + 1).alias("epochs_run"))
