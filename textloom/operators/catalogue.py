"""From catalogue pages and texts to book records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import is_present
from textloom.functions.whitespace import strip
from textloom.operators.prefix import prefix_sums

# The author of books without one, and a page's number of books.
UNKNOWN = "Unknown"
PAGE_SIZE = 25


def page_url(base: str, bookshelf_id: Column, page_index: Column) -> Column:
    """A shelf page's address; pages after the first name the number of their first book."""
    start = F.when(page_index > 0, F.concat(F.lit("?start_index="), (page_index * PAGE_SIZE + 1).cast("string"))).otherwise("")
    return F.concat(F.lit(f"{base}/ebooks/bookshelf/"), bookshelf_id, start)


def id_of_link(link: Column) -> Column:
    """What follows the last slash; a query string stays, a slash at the end gives ''."""
    return F.element_at(F.split(link, "/", -1), -1)


def books(items: DataFrame, base: str, *keep: str) -> DataFrame:
    """(keep, id, title, author, url): items with a title and a link; a missing author is Unknown, an empty one stays empty."""
    whole = items.where(F.col("title").isNotNull() & F.col("link").isNotNull())
    book = id_of_link(F.col("link"))
    return whole.select(*keep, book.alias("id"), strip(F.col("title")).alias("title"), F.coalesce(strip(F.col("subtitle")), F.lit(UNKNOWN)).alias("author"), F.concat(F.lit(f"{base}/ebooks/"), book).alias("url"))


def pages_until_empty(pages: DataFrame, shelf: str = "bookshelf_id", page: str = "page_index", n_items: str = "n_items") -> DataFrame:
    """The pages a scan reads that stops at a shelf's first page without items. One row a shelf is joined, however many pages it has."""
    stop = pages.where(F.col(n_items) == 0).groupBy(F.col(shelf).alias("__s")).agg(F.min(page).alias("__stop"))
    return pages.join(stop, F.col(shelf) == F.col("__s"), "left").where(F.col("__stop").isNull() | (F.col(page) < F.col("__stop"))).drop("__s", "__stop")


def within_failure_budget(attempts: DataFrame, shelf: str = "bookshelf_id", attempt: str = "attempt", status: str = "status", budget: int = 5) -> DataFrame:
    """The attempts a scan makes that gives a shelf up after budget failures in all; a success does not reset the count."""
    failed = F.when(F.col(status) == 200, 0).otherwise(1).cast("bigint")
    return prefix_sums(attempts, [shelf], [attempt], {"__failed": failed}).where(F.col("__failed") < budget).drop("__failed")


def ok_responses(responses: DataFrame, status: str = "status") -> DataFrame:
    return responses.where(F.col(status) == 200)


def first_text(*sources: Column) -> Column:
    """The first source that is not null: cache, primary, alternative."""
    return F.coalesce(*sources)


def with_texts(catalogue: DataFrame, texts: DataFrame, book_id: str = "id", text_id: str = "id", text: str = "text", value: Column | None = None) -> DataFrame:
    """catalogue with content, the book's text or a value of it; books whose text is missing or empty are dropped. A value (a length, a digest) is computed where the texts lie, and the texts are then not shuffled."""
    right = texts.where(is_present(F.col(text))).select(F.col(text_id).alias("__id"), (F.col(text) if value is None else value).alias("content"))
    return catalogue.join(right, F.col(book_id) == F.col("__id")).drop("__id")
