"""Catalogue pages: items with a title, a subtitle and a link to a book."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The page's classes and the part of a link that marks a book's page.
ITEM, TITLE, SUBTITLE, BOOK_LINK = "booklink", "title", "subtitle", "/ebooks/"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Items(HTMLParser):
    """Collects, of each list item of class ITEM, the text of its first title and subtitle and its first book link."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.open: list[tuple[str, dict | None, str | None]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        item = field = None
        if tag == "li" and ITEM in classes:
            item = {"title": None, "subtitle": None, "link": None}
            self.items.append(item)
        inside = [x for _, x, _ in self.open if x is not None]
        if tag == "span":
            for name in (TITLE, SUBTITLE):
                if name in classes and inside and inside[-1][name] is None:
                    inside[-1][name], field = "", name
        if tag == "a" and BOOK_LINK in (a.get("href") or ""):
            for x in inside:
                if x["link"] is None:
                    x["link"] = a["href"]
        if tag not in _VOID:
            self.open.append((tag, item, field))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        inside = [x for _, x, _ in self.open if x is not None]
        fields = [f for _, _, f in self.open if f]
        if inside and fields:
            inside[-1][fields[-1]] += data


def items_of(html: str) -> list[dict]:
    parser = _Items()
    parser.feed(html)
    parser.close()
    return parser.items


def page_items(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """keep, item_no, title, subtitle and link of each item of each page, as found (null where an element is missing). Null pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            at, out = [], []
            for i, text in enumerate(texts.to_pylist()):
                for k, item in enumerate(items_of(text) if text else []):
                    at.append(i)
                    out.append((k, item["title"], item["subtitle"], item["link"]))
            cols = list(zip(*out)) or [()] * 4
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in kept), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], [*keep, "item_no", "title", "subtitle", "link"])

    schema = "".join(f"`{c}` {t}, " for c, t in pages.select(*keep).dtypes)
    return pages.select(*keep, html).mapInArrow(run, f"{schema}item_no bigint, title string, subtitle string, link string")


def page_items_regex(html: Column) -> Column:
    """Array of (title, subtitle, link) by regular expressions inside the JVM, for pages of plain, well-formed markup without entities."""
    items = F.regexp_extract_all(html, F.lit(rf"(?s)<li\b[^>]*\bclass=\"[^\"]*\b{ITEM}\b[^\"]*\"[^>]*>(.*?)</li>"), F.lit(1))
    first = lambda x, pattern: F.get(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(0))
    span = lambda c: rf"(?s)<span\b[^>]*\bclass=\"[^\"]*\b{c}\b[^\"]*\"[^>]*>(.*?)</span>"
    return F.transform(items, lambda x: F.struct(first(x, span(TITLE)).alias("title"), first(x, span(SUBTITLE)).alias("subtitle"), first(x, rf"<a\b[^>]*\bhref=\"([^\"]*{BOOK_LINK}[^\"]*)\"").alias("link")))
