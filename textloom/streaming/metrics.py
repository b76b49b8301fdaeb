"""Streams of step metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.metrics import due

SCHEMA = "run_id string, step bigint, epoch int, split string, loss double, ntp_loss double, kd_loss double, perplexity double, learning_rate double, logged_at timestamp, ingested_at timestamp"


def read_metrics(spark: SparkSession, path: str, schema: str = SCHEMA, fmt: str = "parquet", per_trigger: int = 64) -> DataFrame:
    """New files of a folder as a stream, so many at a time."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def triggered(stream: DataFrame, every: int, step: str = "step") -> DataFrame:
    """The rows of every so many steps: groups by count need no event time and no state."""
    return stream.where(due(F.col(step), every))


def write_metrics(stream: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes each micro-batch to its own folder batch=<id> of sink. A batch that is replayed after a failure replaces its folder, so rows are neither lost nor doubled."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
