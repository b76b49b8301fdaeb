"""Step metrics: means, accumulation, best values, schedules and triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.prefix import ordinals, prefix_sums


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key, the one of the greatest version; of rows written twice, one. A grouped maximum, no window."""
    rest = [c for c in df.columns if c not in {*keys, version}]
    best = df.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("__b"))
    return best.select(*keys, "__b.*").select(*df.columns)


def finite(value: Column, most: float = 1e6) -> Column:
    """The value, or null where it is NaN, infinite or beyond most."""
    return F.when(~F.isnan(value) & (F.abs(value) <= most), value)


def evaluation(df: DataFrame, *by: str, batch: str = "batch", losses: tuple[str, ...] = ("loss", "ntp_loss", "kd_loss"), steps: int | None = None) -> DataFrame:
    """(by, batches, one mean a loss, perplexity): the mean over batches of each batch's mean, whatever its size, and exp of the first loss's mean. steps takes the first so many batches in the order of batch, whatever their numbers. Without rows there is no row."""
    each = df.groupBy(*by, batch).agg(*(F.avg(c).alias(c) for c in losses))
    if steps is not None:
        each = ordinals(each, list(by), [batch], "__i").where(F.col("__i") < steps)
    out = each.groupBy(*by).agg(F.count("*").alias("batches"), *(F.avg(c).alias(c) for c in losses))
    return out.withColumn("perplexity", F.exp(losses[0]))


def accumulated(df: DataFrame, run: list[str], order: list[str], losses: tuple[str, ...] = ("loss", "ntp_loss", "kd_loss"), every: int = 4) -> DataFrame:
    """(run, optimizer_step, losses): of each full group of every micro-batches the last one's losses divided by every. A rest that fills no group is not reported."""
    at = ordinals(df.select(*run, *order, *losses), run, order, "__i")
    last = at.where(F.pmod("__i", F.lit(every)) == every - 1)
    return last.select(*run, F.floor(F.col("__i") / every).cast("bigint").alias("optimizer_step"), *((F.col(c) / every).alias(c) for c in losses))


def global_steps(df: DataFrame, run: list[str], order: list[str], done: Column, name: str = "global_step") -> DataFrame:
    """df with the number of optimizer steps done up to and including each row."""
    out = prefix_sums(df, run, order, {name: done.cast("bigint")})
    return out.withColumn(name, F.col(name) + done.cast("bigint"))


def best_so_far(df: DataFrame, run: list[str], order: list[str], value: str) -> DataFrame:
    """df with best_before (least earlier value; null at first) and improved (strictly less than it). NaN and null never improve. For one row an epoch: a run's rows meet in one task."""
    usable = F.when(~F.isnan(value), F.col(value))
    before = F.min(usable).over(W.partitionBy(*run).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("best_before", before).withColumn("improved", F.coalesce(usable < F.coalesce("best_before", F.lit(float("inf"))), F.lit(False)))


def best_batch(df: DataFrame, run: list[str], order: list[str], value: str) -> DataFrame:
    """Each run's final best value and the first row in order that has it, as a grouped minimum for runs of any length."""
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return usable.groupBy(*run).agg(F.min(F.struct(value, *order)).alias("__b")).select(*run, F.col(f"__b.{value}").alias("best"), *(F.col(f"__b.{o}").alias(f"best_{o}") for o in order))


def learning_rate(step: Column, total: int, warmup: int, base: float = 1.0) -> Column:
    """Linear from 0 over warmup steps, then linear to 0 at total."""
    up, down = step / F.lit(float(max(1, warmup))), (F.lit(float(total)) - step) / F.lit(float(max(1, total - warmup)))
    return F.lit(base) * F.when(step < warmup, up).otherwise(F.greatest(F.lit(0.0), down))


def schedule(spark: SparkSession, epochs: int, steps_per_epoch: int, base: float = 1.0, every: int = 1) -> DataFrame:
    """(step, lr) of every so many steps of a run whose first tenth warms up."""
    total = epochs * steps_per_epoch
    warmup = int(0.1 * epochs * steps_per_epoch)
    steps = spark.range(0, total + 1, every).withColumnRenamed("id", "step")
    return steps.withColumn("lr", learning_rate(F.col("step"), total, warmup, base))


def due(step: Column, every: int) -> Column:
    """Whether something done every so many steps is done at this one."""
    return F.pmod(step, F.lit(every)) == 0


def within_cap(micro_step: Column, every: int, cap: int | None) -> Column:
    """Whether a micro-batch comes before the cap on an epoch's optimizer steps; a null cap is none."""
    return F.lit(True) if cap is None else F.floor(micro_step / every) < cap
