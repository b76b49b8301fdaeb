"""Readers: JSON lines, JSON lists, whole texts, pages, caches and folder listings."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(text) of JSON lines. A malformed line fails the read, and so does one without text, which the parser alone would let pass as null."""
    rows = spark.read.schema("text string").option("mode", "FAILFAST").json(path)
    return rows.select(F.coalesce("text", F.raise_error(F.lit("a line has no text")).cast("string")).alias("text"))


def read_json_list(spark: SparkSession, path: str, schema: str = "id string, title string, author string, url string") -> DataFrame:
    """Rows of a file that holds one JSON list."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_texts(spark: SparkSession, path: str, errors: str = "ignore") -> DataFrame:
    """(path, id, text): one row a file; id is the file's name without book_ and its ending. Bytes are decoded by decode_bytes; line ends stay as they are."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("__n"), decode_bytes(F.col("content"), errors).alias("text")).select("path", F.regexp_replace("__n", "^book_", "").alias("id"), "text")


def detect(data: bytes) -> str:
    """The likely encoding: that of a byte order mark; UTF-8 where the bytes are valid; else what the detection library says, if it is installed; else that of detect_legacy."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return name
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        import chardet
    except ImportError:
        return detect_legacy(data)
    return chardet.detect(data)["encoding"] or detect_legacy(data)


# The code pages of texts that are not Unicode, and the letters that are common in them.
LEGACY = {"cp1252": "éèàùâêîôûëïüçäößñáíóúæœ", "cp1253": "αεηιοτνσρκπλμςάέήίόύώ", "cp1251": "оеаинтсрвлкмдпу", "gb18030": "的一是不了人我在有他这中大来上"}


def detect_legacy(data: bytes) -> str:
    """The code page in whose reading the largest share of the letters beyond ASCII are common ones; cp1252 if none stands out, which loses no letter of Latin-1. UTF-16 without a mark is told by its zero bytes."""
    even, odd = data[0::2].count(0), data[1::2].count(0)
    if len(data) > 3 and max(even, odd) > len(data) // 8:
        return "utf-16-be" if even > odd else "utf-16-le"
    best, top = "cp1252", 0.0
    for name, common in LEGACY.items():
        read = [c for c in data.decode(name, "replace").lower() if ord(c) > 127]
        share = sum(c in common for c in read) / max(1, len(read))
        if share > top:
            best, top = name, share
    return best


def decode_bytes(content: Column, errors: str = "ignore") -> Column:
    """Text of binary content in its detected encoding, undecodable bytes ignored."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if b is None else b.decode(detect(b), errors) for b in batch.to_pylist()], pa.string())

    return decode(content)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """A table written by sinks.cache, or None if there is none."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
    return spark.read.parquet(path) if there else None


def listing(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(file_name, length): files of a folder whose names start with prefix; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file_name"), "length")


def matching_variables(variables: DataFrame, needles: list[str], name: str = "name") -> DataFrame:
    """Variables whose lower-cased name contains one of the needles."""
    from textloom.functions.text import contains_any

    return variables.where(contains_any(F.col(name), needles))
