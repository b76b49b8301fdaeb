"""Catalogue pages: saved ones by any Hadoop path, and a scan that fetches them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "bookshelf_id string, page_index bigint, html string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(bookshelf_id, page_index, html) of pages written by sinks.writers.write_pages. A filter on the shelf or the page prunes folders, so others are not opened."""
    pages = spark.read.schema("value string, bookshelf_id string, page_index bigint").text(path, wholetext=True)
    return pages.select("bookshelf_id", "page_index", F.regexp_replace("value", r"\n\z", "").alias("html"))


def read_page_files(spark: SparkSession, folder: str, bookshelf_id: str | None = None) -> DataFrame:
    """(bookshelf_id, page_index, html) of files bookshelf_<id>_page_<n>.html; with a shelf, only its files are listed."""
    files = spark.read.option("pathGlobFilter", f"bookshelf_{bookshelf_id or '*'}_page_*.html").text(folder, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"bookshelf_([^/]+)_page_(\d+)\.html$", 1), F.regexp_extract(F.input_file_name(), r"_page_(\d+)\.html$", 1)
    return files.select(name[0].alias("bookshelf_id"), name[1].cast("bigint").alias("page_index"), F.col("value").alias("html"))


def scan_pages(shelves: DataFrame, fetch: Callable[[str, int], tuple[int, str]], has_items: Callable[[str], bool], budget: int = 5, shelf: str = "bookshelf_id") -> DataFrame:
    """(bookshelf_id, page_index, html): the pages of each shelf, fetched in order where the shelves' rows lie.

    fetch(bookshelf_id, page_index) gives a status and a body. A page is asked for
    again until it comes with status 200; a shelf ends at its first page without
    items, or when budget fetches have failed in all (a success does not reset the
    count). Null shelves have no pages. fetch runs on executors: it must be
    picklable, and repeating it after a lost executor must do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                page, failed = 0, 0
                while s is not None and failed < budget:
                    status, body = fetch(s, page)
                    if status != 200:
                        failed += 1
                        continue
                    if not has_items(body):
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.string()), pa.array([page], pa.int64()), pa.array([body], pa.string())], ["bookshelf_id", "page_index", "html"])
                    page += 1

    return shelves.select(F.col(shelf).cast("string")).mapInArrow(run, SCHEMA)
