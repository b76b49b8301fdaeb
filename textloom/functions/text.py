"""Text functions: cleaning, boilerplate, lines, JSON lines. All are column expressions over built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.whitespace import collapse, collapse_blanks, strip

# What frames a book's text, and the abbreviation that cleaning spells out.
START, END = "*** START OF", "*** END OF"
ABBREVIATION, EXPANSION = "viz.", "namely"


def clean_text(text: Column) -> Column:
    """White space collapsed; underscores and round brackets deleted; then the abbreviation spelled out, also inside words; white space collapsed again. Null stays null."""
    bare = F.translate(collapse(text), "_()", "")
    return collapse_blanks(F.replace(bare, F.lit(ABBREVIATION), F.lit(EXPANSION)))


def strip_boilerplate(text: Column) -> Column:
    """The lines between the last start marker before the first end marker and that end marker.

    A line with both markers is a start. Without a start the text begins at its first
    line, without an end it goes to the last; lines end at line feeds only.
    """
    lines = F.split(text, "\n", -1)
    # one flag a line: s starts, e ends, - neither; the first e ends the body, the last s before it starts it
    flags = F.array_join(F.transform(lines, lambda x: F.when(F.contains(x, F.lit(START)), "s").when(F.contains(x, F.lit(END)), "e").otherwise("-")), "")
    head = F.substring_index(flags, "e", 1)
    body = F.substring_index(head, "s", -1)
    return F.array_join(F.slice(lines, F.length(head) - F.length(body) + 1, F.length(body)), "\n")


def is_present(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def long_enough(text: Column, more_than: int = 1000) -> Column:
    """Whether the text has more than so many characters without white space at its ends; the text itself is not changed."""
    return F.length(strip(text)) > more_than


def json_line(text: Column) -> Column:
    """One JSON-lines record with the text, a blank after the colon, nothing but control characters, quotes and backslashes escaped."""
    body = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("text")))
    return F.concat(F.lit('{"text": '), F.substring(body, F.lit(9), F.length(body)))


def json_line_length(text: Column) -> Column:
    """Characters of json_line(text) without building it a second time."""
    return F.length(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("text")))) + 1


def json_line_bytes(text: Column) -> Column:
    """Bytes that the record takes in a file, its line feed included."""
    return F.octet_length(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("text")))) + 2


def words(text: Column) -> Column:
    """Cleaned text's words; an empty array for empty text."""
    return F.array_remove(F.split(text, " ", -1), "")


def contains_any(value: Column, needles: Sequence[str]) -> Column:
    """Whether the lower-cased value contains one of the needles."""
    low = F.lower(value)
    return F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(low, n))


def prefix(text: Column, n: int = 100) -> Column:
    return F.left(text, F.lit(n))


def stamp(ts: Column) -> Column:
    """The form of time stamps in names of runs and folders."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_name(path: Column) -> Column:
    """What comes before the last slash; '' if there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "")


def metric_label(template: str, *values: Column) -> Column:
    """Formatted numbers for logs and names, as '%.4f'."""
    return F.format_string(template, *values)
