"""Sinks: JSON lines, metadata documents, metric and sample tables, caches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import is_present, json_line


def write_jsonl(df: DataFrame, path: str, text: str = "text", order: list[str] | None = None, single: bool = False) -> None:
    """One line {"text": ...} a record with text. In order, files sort by range and their names by number, so reading them one after the other gives the order; single makes it one file, for corpora that fit one task."""
    rows = df.where(is_present(F.col(text)))
    if single:
        rows = rows.coalesce(1)
        rows = rows.sortWithinPartitions(*order) if order else rows
    elif order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(json_line(F.col(text)).alias("value")).write.mode("overwrite").text(path)


def write_metadata(documents: DataFrame, path: str, shelf: str = "bookshelf_id", document: str = "document") -> None:
    """One file a shelf with its metadata document (operators.offsets.metadata_documents), in folders by shelf; only the shelves written are replaced."""
    rows = documents.select(F.col(shelf).alias("bookshelf_id"), F.col(document).alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bookshelf_id").text(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (bookshelf_id, page_index, html), a file each in folders by shelf and page; of a page written again, the last stays."""
    rows = pages.select("bookshelf_id", "page_index", F.col("html").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bookshelf_id", "page_index").text(path)


def append_metrics(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_samples(df: DataFrame, path: str, epoch: int, step: int) -> None:
    """Samples of one evaluation; writing the same epoch and step again replaces them."""
    df.write.mode("overwrite").json(f"{path}/epoch={epoch}/step={step}")


def fingerprint(*parts: object) -> str:
    """A short digest of whatever a cached table depends on."""
    return hashlib.sha256(json.dumps(parts, default=str, sort_keys=True).encode()).hexdigest()[:16]


def content_digest(df: DataFrame, *columns: str) -> str:
    """A digest of rows in any order: their number and the sum of their hashes, in one pass."""
    n, h = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return fingerprint(n, h)


def cache(df: DataFrame, folder: str, *key: object) -> DataFrame:
    """df, read from folder if a table of this key was written there before, else written first. The key should name the source's digest, the tokenizer, the window's sizes and the cleaning's version."""
    from textloom.sources.readers import read_cache

    path = f"{folder}/{fingerprint(*key)}"
    found = read_cache(df.sparkSession, path)
    if found is not None:
        return found
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def evict(spark: SparkSession, folder: str, *keep: tuple) -> list[str]:
    """Removes cached tables whose key is not among keep; returns their names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = {fingerprint(*k) for k in keep}
    gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in names]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)


def run_folders(spark: SparkSession, root: str, name: str) -> dict[str, str]:
    """The folders of a run, made wherever root's file system is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made = {part: f"{root.rstrip('/')}/run_{name}/{part}" for part in ("evaluations", "checkpoints", "plots")}
    for path in made.values():
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).mkdirs(at)
    return made


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, object]:
    """df with an observation: the metrics come with whatever action runs on df, without another pass."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return df.observe(watch, *(c.alias(k) for k, c in metrics.items())), watch
