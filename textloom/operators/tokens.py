"""Vocabularies and tokenizers over columns."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import clean_text, words
from textloom.operators.prefix import ordinals


class Tokenizer(Protocol):
    """Turns a text column into an array of tokens or ids; specials is the number of special tokens a sequence takes."""

    specials: int

    def __call__(self, text: Column) -> Column: ...


class WordTokenizer:
    """Blank-separated words of the cleaned text, inside the JVM."""

    specials = 1

    def __call__(self, text: Column) -> Column:
        return words(clean_text(text))


class LibraryTokenizer:
    """A tokenizer file of the tokenizers library, by Arrow batches; gated on the library."""

    def __init__(self, path: str, specials: int = 1) -> None:
        self.path, self.specials = path, specials

    def __call__(self, text: Column) -> Column:
        import pandas as pd

        path = self.path

        @F.pandas_udf("array<int>")
        def encode(batches: pd.Series) -> pd.Series:
            from tokenizers import Tokenizer as Library

            t = Library.from_file(path)
            t.encode_special_tokens = True
            return pd.Series([e.ids for e in t.encode_batch([x or "" for x in batches], add_special_tokens=False)])

        return encode(text)


def vocabulary(df: DataFrame, tokens: str, reserved: int = 2) -> DataFrame:
    """(token, token_id, n): the distinct non-empty tokens in the order of their bytes, ids from reserved on."""
    # explode would make the optimizer filter by the array's size first, and compute the tokens once more for that
    counted = df.select(F.explode_outer(tokens).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    return ordinals(counted, [], ["token"], "__at").select("token", (F.col("__at") + reserved).alias("token_id"), "n")


def decode(ids: Column, vocabulary: Column, skip: list[int]) -> Column:
    """Tokens of ids by a literal array, special ids skipped, joined by blanks."""
    kept = F.filter(ids, lambda i: ~i.isin(skip)) if skip else ids
    return F.array_join(F.transform(kept, lambda i: F.get(vocabulary, i)), " ")
