"""Losses over tables of logits, one row a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import cross_entropy, kl_divergence

NAN = float("nan")


def position_losses(df: DataFrame, student: str = "student", teacher: str = "teacher", label: str = "label") -> DataFrame:
    """df with ntp (cross-entropy of the label) and kd (divergence of the student from the teacher) of each position. Student and teacher lie in one row, so nothing is shuffled."""
    return df.withColumns({"ntp": cross_entropy(F.col(student), F.col(label)), "kd": kl_divergence(F.col(student), F.col(teacher))})


def combine(ntp: Column, kd: Column, ratio: float) -> Column:
    """ratio * kd + (1 - ratio) * ntp; a NaN of either spoils the sum, even at weight 0."""
    return F.lit(ratio) * kd + F.lit(1 - ratio) * ntp


def mean_losses(df: DataFrame, *by: str, label: str = "label", pad: int | None = None, ratio: float = 1.0) -> DataFrame:
    """(by, positions, targets, ntp_loss, kd_loss, loss) of rows with ntp, kd and label.

    ntp_loss is the mean over positions whose label is not pad, NaN if there are none;
    kd_loss the mean over all positions, padding included.
    """
    target = F.col(label).isNotNull() if pad is None else F.col(label) != pad
    out = df.groupBy(*by).agg(F.count("*").alias("positions"), F.count(F.when(target, 1)).alias("targets"), F.coalesce(F.avg(F.when(target, F.col("ntp"))), F.lit(NAN)).alias("ntp_loss"), F.avg("kd").alias("kd_loss"))
    return out.withColumn("loss", combine(F.col("ntp_loss"), F.col("kd_loss"), ratio))


def zip_positions(student: DataFrame, teacher: DataFrame, keys: tuple[str, ...] = ("example_id", "pos")) -> DataFrame:
    """Student's and teacher's rows side by side where they come as two tables: one equi-join on the position."""
    return student.join(teacher, list(keys))


def causal_targets(df: DataFrame, key: str, logits: str = "logits", labels: str = "labels") -> DataFrame:
    """(key, pos, logits, label): of sequences with one array of logits a position, all but the last position with the label that follows."""
    shifted = F.arrays_zip(F.slice(logits, 1, F.greatest(F.size(logits) - 1, F.lit(0))).alias("logits"), F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))).alias("label"))
    return df.select(key, F.posexplode(shifted).alias("pos", "z")).select(key, "pos", "z.logits", "z.label")
