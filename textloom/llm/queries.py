"""The queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import encode, lines, neardup, overlap, packing, pieces, spans, tokencount
from textloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.line_table(table(spark, folder, "documents"))
    return lines.line_occurrences(rows, lines.frequent_lines(rows))


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "bookshelf_id", "text")
    rows = lines.line_table(docs)
    found = lines.line_occurrences(rows, lines.frequent_lines(rows))
    return lines.without_lines(docs, found).select("doc_id", "text", F.col("n_removed").cast("long").alias("n_removed"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.line_table(table(spark, folder, "documents"))
    return lines.line_report(rows, lines.repeated_lines(rows)).withColumnRenamed("src", "bookshelf_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spans.shared_pairs(spans.shared_spans(table(spark, folder, "documents")))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_shared(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return spans.shared_characters(docs, spans.shared_spans(docs))


def p8_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return spans.span_groups(docs, spans.shared_spans(docs))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return neardup.near_duplicate_pairs(docs).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, folder, "documents"))


def p2_budget(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.token_budget(table(spark, folder, "documents"), table(spark, folder, "bookshelves"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.text_pieces(table(spark, folder, "documents")).unionAll(pieces.token_pieces(table(spark, folder, "examples")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.cut_items(p5_pieces(spark, folder))


def p5_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.invariants(p5_pieces(spark, folder))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p7_containers(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.split_items(p7_containers(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(table(spark, folder, "documents"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """By language: documents, their characters, and documents whose decoded ids are not the stored text (null counting as empty)."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    decoded = encode.encode(docs).select(F.col("doc_id").alias("id"), encode.decode(F.col("ids")).alias("decoded"))
    joined = docs.join(decoded, F.col("doc_id") == F.col("id"))
    differs = (F.col("decoded") != F.col("text")).cast("long")
    return joined.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("decoded").cast("long")).alias("n_chars"), F.sum(differs).alias("n_different"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = overlap.split_overlaps(table(spark, folder, "corpus_records")).pairs()
    return found.select(F.least("e", "t").alias("rec_id_a"), F.greatest("e", "t").alias("rec_id_b")).distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "corpus_records")
    return overlap.overlap_report(records, overlap.split_overlaps(records))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
