"""Text functions against small restatements in Python."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import html, text
from textloom.functions.whitespace import collapse, strip

START, END = text.START, text.END


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("", ""), (" ", ""), ("( )", ""), ("_viz._ a ( ) b", "namely a b"), ("v_iz. (x)", "namely x"), ("Viz.   y\x1cz\x0bq", "Viz. y z q"), ("a​b", "a​b"), (None, None)],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


def body(t: str) -> str:
    lines = t.split("\n")
    start, end = 0, len(lines)
    for i, line in enumerate(lines):
        if START in line:
            start = i + 1
        elif END in line:
            end = i
            break
    return "\n".join(lines[start:end])


@pytest.mark.parametrize(
    ("lines", "want"),
    [(["a", "b"], "a\nb"), ([START, "a", "b", END], "a\nb"), (["h", START, START, "a", END, START, "z"], "a"), (["a", END, START, "b"], "a"), ([START + END, "a"], "a"), ([END], ""), ([START], ""), (["s", "e", "-"], "s\ne\n-"), ([""], "")],
)
def test_strip_boilerplate(spark, lines, want):
    assert one(spark, "\n".join(lines), text.strip_boilerplate) == want == body("\n".join(lines))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=40))
def test_white_space_and_json_like_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in df.select("i", collapse(F.col("t")).alias("c"), strip(F.col("t")).alias("s"), text.json_line(F.col("t")).alias("j"), text.json_line_length(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i].c == " ".join(t.split())
        assert got[i].s == t.strip()
        assert json.loads(got[i].j) == {"text": t}
        assert got[i].n == len(got[i].j)


def test_json_line_has_pythons_form(spark):
    for t in ("", 'a"b\\c\n\té中\U0001f600', "x" * 5):
        assert one(spark, t, text.json_line) == json.dumps({"text": t}, ensure_ascii=False)


def test_length_filter_is_strict(spark):
    assert one(spark, " " + "x" * 1000 + " ", text.long_enough) is False
    assert one(spark, "x" * 1001, text.long_enough) is True


def test_page_items(spark):
    page = '<ul><li class="x booklink"><a href="/other"></a><a href="/ebooks/1?f=t"><span class="title"> A &amp; <b>B</b></span><br><span class="subtitle"></span></a></li><li class="booklink"><span class="title">no link</span></li><li>no item</li><li class="booklink"><a href="/ebooks/2/">x</a><span class="title">C</span><span class="title">D</span></ul>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page int, html string")
    got = sorted(tuple(r) for r in html.page_items(df, "html", "page").collect())
    assert got == [(1, 0, " A & B", "", "/ebooks/1?f=t"), (1, 1, "no link", None, None), (1, 2, "C", None, "/ebooks/2/")]
    regex = spark.createDataFrame([('<li class="booklink"><a href="/ebooks/7"><span class="title">T</span><span class="subtitle">S</span></a></li>',)], "h string").select(F.explode(html.page_items_regex(F.col("h")))).first()[0]
    assert tuple(regex) == ("T", "S", "/ebooks/7")


def test_contains_any_and_stamp(spark):
    assert one(spark, "SLURM_x", lambda c: text.contains_any(c, ["slurm", "mpi"])) is True
    assert one(spark, "2031-03-01 01:02:03", lambda c: text.stamp(c.cast("timestamp"))) == "20310301_010203"
    assert one(spark, "a/b/c.txt", text.file_name) == "c.txt" and one(spark, "a/b/c.txt", text.folder_name) == "a/b" and one(spark, "c", text.folder_name) == ""
