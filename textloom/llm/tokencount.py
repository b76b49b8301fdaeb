"""Problem 2: how many tokens each source, language and domain holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe import BYTE_BPE_50K, PATTERN, Encoder, double_array, read_ranks

# Unicode's White_Space, in place of \s, whose extent differs between engines.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SEGMENTS = PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s+(?!\S)", f"[{SPACE}]+(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")

_encoders: dict[str, Encoder] = {}
_broadcasts: dict[tuple[str, str], object] = {}


def vocabulary(spark: SparkSession, path: str):
    """The ranks and their double array, broadcast once a session. Their size is the vocabulary's (2 MB at 50,000 tokens), whatever the data's."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _broadcasts:
        _broadcasts[key] = spark.sparkContext.broadcast((read_ranks(path), double_array(path)))
    return _broadcasts[key]


def encoder(path: str, shared) -> Encoder:
    """This worker's encoder, kept from task to task with what it has learnt."""
    if path not in _encoders:
        _encoders[path] = Encoder(*shared.value)
    return _encoders[path]


def token_counts(df: DataFrame, text: str, *keep: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """The columns keep and n_tokens (bigint), the number of tokens of text without special tokens; 0 for null and empty texts.

    Segments are counted by a walk over the vocabulary's trie, each distinct one once
    in a worker (a bounded memory). No row is shuffled; df's partitions stay. The
    strings of special tokens are plain text.
    """
    shared = vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, segments = encoder(path, shared).count, regex.compile(SEGMENTS).findall
        for batch in batches:
            *kept, texts = batch.columns
            n = [sum(map(count, segments(t))) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], [*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    return df.select(*keep, F.col(text)).mapInArrow(run, f"{schema}{', ' * bool(keep)}n_tokens bigint")


# Three-letter codes of the languages in use.
LANGUAGES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "lat": "la", "ell": "el", "gre": "el", "zho": "zh", "chi": "zh"}


def normal_language(lang: Column) -> Column:
    """The language's two-letter code in lower case without region or script; 'und' for null, empty and undetermined."""
    code = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2,3})", 1)
    short = F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), code)
    return F.coalesce(short, F.nullif(code, F.lit("")), F.lit("und"))


def normal_source(source: Column) -> Column:
    """The source's path trimmed, in lower case and without a leading './'; 'unknown' for null and empty."""
    path = F.regexp_replace(F.lower(F.trim(source)), r"^(\./)+", "")
    return F.when(source.isNull() | (path == ""), "unknown").otherwise(path)


def token_budget(docs: DataFrame, shelves: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """Documents and tokens by source, language and domain, for each of the three alone, together and in all.

    Columns: slicing (which of the grouping sets), source, lang, domain_name (null where
    summed over), n_docs, n_without_text (null or empty), n_renamed (documents
    whose source or language was stored in another spelling or not at all), n_chars
    (measured, not the stored number) and n_tokens. A shelf that is null, unknown or has no domain counts under 'unknown'.
    Every document counts in exactly one slice of each grouping. An empty table gives
    no rows.

    Tokens are counted where the rows lie; the shelves join after partial sums by
    (source, lang, shelf), so what is shuffled has the number of slices as its size.
    """
    d = docs.select(
        normal_source(F.col("source")).alias("source"), normal_language(F.col("lang")).alias("lang"), "bookshelf_id",
        (~F.col("source").eqNullSafe(normal_source(F.col("source"))) | ~F.col("lang").eqNullSafe(normal_language(F.col("lang")))).cast("long").alias("renamed"),
        (F.coalesce(F.length("text"), F.lit(0)) == 0).cast("long").alias("bare"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), "text",
    )
    counted = token_counts(d, "text", "source", "lang", "bookshelf_id", "renamed", "bare", "chars", path=path)
    summed = counted.groupBy("source", "lang", "bookshelf_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("bare", "renamed", "chars", "n_tokens")))
    names = shelves.groupBy(F.col("bookshelf_id").alias("__shelf")).agg(F.min("domain_name").alias("__domain"))
    named = summed.join(names, F.col("bookshelf_id") == F.col("__shelf"), "left").withColumn("domain_name", F.coalesce("__domain", F.lit("unknown")))
    sets = [["source"], ["lang"], ["domain_name"], ["source", "lang", "domain_name"], []]
    out = named.groupingSets([[F.col(c) for c in s] for s in sets], "source", "lang", "domain_name").agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n_docs"), F.sum("bare").alias("n_without_text"), F.sum("renamed").alias("n_renamed"), F.sum("chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens")
    )
    slicing = F.element_at(F.create_map(*(F.lit(x) for kv in ((3, "source"), (5, "lang"), (6, "domain_name"), (0, "source, lang, domain_name"), (7, "all")) for x in kv)), F.col("g").cast("int"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(slicing.alias("slicing"), "source", "lang", "domain_name", *(number(c) for c in ("n_docs", "n_without_text", "n_renamed", "n_chars", "n_tokens")))
