"""Where records stand in JSON-lines files, and what files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import is_present, json_line_bytes, json_line_length
from textloom.operators.prefix import prefix_sums


def record_offsets(df: DataFrame, file: str, order: list[str], text: str = "text", unit: str = "characters", keep: tuple[str, ...] = ()) -> DataFrame:
    """(file, order, keep, start_position, end_position, text_length): each record's place among its file's lines, in order; a line feed follows each.

    unit 'characters' counts code points of the JSON lines, 'bytes' UTF-8 bytes. Null
    text counts as empty. Lengths are taken where the texts lie; the texts themselves
    are neither written nor shuffled.
    """
    line = json_line_length(F.col(text)) if unit == "characters" else json_line_bytes(F.col(text)) - 1
    sized = df.select(file, *order, *keep, line.cast("bigint").alias("__line"), F.length(F.coalesce(text, F.lit(""))).cast("bigint").alias("text_length"))
    placed = prefix_sums(sized, [file], order, {"start_position": F.col("__line") + 1})
    return placed.withColumn("end_position", F.col("start_position") + F.col("__line")).select(file, *order, *keep, "start_position", "end_position", "text_length")


def corpus_totals(df: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """(by, num_books, total_chars, text_chars): records with text, the bytes their lines take in a file (total_chars, named as the metadata has it) and their characters."""
    return df.where(is_present(F.col(text))).groupBy(*by).agg(F.count("*").alias("num_books"), F.sum(json_line_bytes(F.col(text)).cast("bigint")).alias("total_chars"), F.sum(F.length(text).cast("bigint")).alias("text_chars"))


def metadata(df: DataFrame, shelf: str, split: str, file: str, order: str, fields: tuple[str, ...] = ("id", "title", "author", "url"), text: str = "text") -> DataFrame:
    """(shelf, split, file_path, num_books, books, total_chars, format): what the metadata says of each shelf's split and file.

    books lists, in order, the fields of the records with text, their positions in
    the file's lines and their length; total_chars is the bytes that their lines take
    in the file. A list's size is its document's, which one reader must hold; for
    tables of any size use record_offsets.
    """
    size = F.when(is_present(F.col(text)), json_line_bytes(F.col(text))).cast("bigint")
    placed = record_offsets(df.withColumn("__size", size), file, [order], text, keep=(shelf, split, *fields, "__size")).where(F.col("__size").isNotNull())
    book = F.struct(order, *fields, "start_position", "end_position", F.col("text_length").alias("length"))
    rows = placed.groupBy(shelf, split, F.col(file).alias("file_path")).agg(F.count("*").alias("num_books"), F.array_sort(F.collect_list(book)).alias("books"), F.sum("__size").alias("total_chars"))
    books = F.transform("books", lambda b: b.dropFields(order)) if order not in fields else F.col("books")
    return rows.withColumns({"books": books, "format": F.lit("jsonl")})


def metadata_documents(found: DataFrame, shelf: str, split: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """(shelf, document): one pretty-printed JSON document a shelf, {"bookshelf_id", "train": {"num_books", "books", "total_chars", "format", "file_path"}, "test": {...}}, from the rows of metadata; a split without rows is left out. Documents are made where the rows lie; nothing comes to the driver."""
    body = F.struct("num_books", "books", "total_chars", "format", "file_path")
    parts = found.groupBy(shelf).agg(*(F.first(F.when(F.col(split) == s, body), ignorenulls=True).alias(s) for s in splits))
    return parts.select(shelf, F.to_json(F.struct(F.col(shelf).alias("bookshelf_id"), *splits), {"pretty": "true"}).alias("document"))
