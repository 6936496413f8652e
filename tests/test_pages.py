"""Release dates from fetched pages and from inline rows (K18-K20, S4)."""

import datetime as dt
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from marquee.functions import exprs as X
from marquee.operators import explore as E
from marquee.sources.memory import release_date_rows
from marquee.sources.schema import PAGES_SCHEMA

PAGE = ('<html><span class="x">-</span><span class="a release b"> {d} </span>'
        '<span class="release">January 1, 1900</span></html>')


def pages(spark):
    rows = [
        ("T1", 200, PAGE.format(d="March 5, 2020")),      # first match wins, padding trimmed
        ("T2", 404, PAGE.format(d="March 6, 2020")),      # not a 200
        ("T3", 200, "<html><p>no date</p></html>"),        # no match
        ("T4", 200, '<span class="releases">x</span>'),     # a longer class token only
        ("T5", 200, None),
    ]
    return spark.createDataFrame(rows, PAGES_SCHEMA)


def test_extract_field_cases(spark):
    got = {r.title: r.value for r in E.extract_field(pages(spark), "span", "release").collect()}
    assert got == {"T1": "March 5, 2020", "T2": None, "T3": None, "T4": None, "T5": None}


@pytest.mark.parametrize("html, text", [
    ('<span class="release">January <b>5</b>, 2020</span>', "January 5, 2020"),
    ('<span class="release"><a>May 1, 2020</a></span>', "May 1, 2020"),
    ('<span data-class="release">WRONG</span><span class="release">right</span>', "right"),
    ("<span class='b release'>x</span>", "x"),
    ("<SPAN CLASS=release ID=q>x</SPAN>", "x"),
    ('<span class="b"><i>WRONG</i></span><span\n  id="q"\n  class="release"\n>x</span>', "x"),
    ('<spanner class="release">WRONG</spanner><span class="release">x</span>', "x"),
    ('<span class="release">&nbsp;a &amp;lt; b\n</span>', "a &lt; b"),
    ('<span class="release">open to the end', "open to the end"),
    ('<span class="Release">x</span>', None),
    ('<span class="release">a<span>b<span class="release">c</span></span>d</span>e', "abcd"),
    ('<span class="release">a<SPAN >b</span><span/>c</span>d</span>e', "abcd"),
    ('<span title="x > y" class="release" alt=\'</span>\'>a<i title=">">b</i></span>c', "ab"),
    ('<!-- <span class="release">WRONG</span> --><span class="release">a<!-- </span> -->b</span>c', "ab"),
    ('<span class="release">a<br>b<img alt="</span>"/>c</span>d', "abc"),
    ('<span class="a" class="release">WRONG</span><span class="release">x</span>', "x"),
    ('<span class="release">1 < 2 and 3 > 2</span>', "1 < 2 and 3 > 2"),
    ('<span class="release"></span>x', ""),
    ('<span class="release">' + "<span>" * 300 + "x" + "</span>" * 301 + "y", "x"),
    ('<span class="release">' + "<span>s</span> " * 3000 + "</span>y", ("s " * 3000).strip()),
    ("<span " + "a=1 " * 5000 + 'class="release">x</span>', "x"),
    ('<span class="release">' + "y" * 200_000 + "</span>", "y" * 200_000),
])
def test_whole_element_text(spark, html, text):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(X.first_element_text("html", "span", "release")).first()[0] == text


def test_void_elements_have_no_text(spark):
    df = spark.createDataFrame([('<p><img class="release">x</p>',), ("<p>x</p>",)], "html string")
    assert [r[0] for r in df.select(X.first_element_text("html", "img", "release")).collect()] == ["", None]


class _First(HTMLParser):
    """The text of the first div of class k, by a parser that is not ours."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.depth, self.text, self.done = 0, None, False

    def handle_starttag(self, tag, attrs):
        if self.done or tag != "div":
            return
        if self.depth:
            self.depth += 1
        elif "k" in (dict(reversed(attrs)).get("class") or "").split():
            self.depth, self.text = 1, []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "div" and self.depth and not self.done:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.depth and not self.done:
            self.text.append(data)


def test_against_a_parser(spark):
    """Random pages of nested, unclosed and commented elements."""
    rng = random.Random(7)
    parts = ["<div>", "<div class='k'>", '<DIV id=x class="a k">', '<div title="a > b" class=k >', "</div>", "</div >", "</DIV>",
             "<p>", "</p>", "<br/>", "<!-- <div class=k> -->", "<!-- </div> -->", "t", "u v ", "<i title='</div>'>", "<divider class=k>"]
    htmls = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    want = []
    for html in htmls:
        parser = _First()
        parser.feed(html)
        parser.close()
        want.append(None if parser.text is None else "".join(parser.text).strip())
    rows = spark.createDataFrame(list(enumerate(htmls)), "i int, html string")
    got = dict(rows.select("i", X.first_element_text("html", "div", "k")).collect())
    assert [(h, got[i], w) for i, (h, w) in enumerate(zip(htmls, want)) if got[i] != w] == []
    assert sum(w is not None for w in want) > 500


def test_release_dates_one_per_title(spark):
    doubled = pages(spark).unionByName(
        spark.createDataFrame([("T1", 200, PAGE.format(d="March 1, 2020"))], PAGES_SCHEMA))
    got = {r.title: r.release_date for r in E.release_dates(doubled).collect()}
    assert got["T1"] == dt.date(2020, 3, 1) and got["T2"] is None


def test_inline_side_table_and_span(spark):
    titles = spark.createDataFrame([("T1",), ("T2",), ("T9",)], "title string")
    dates = release_date_rows(spark, [("T1", "May 1, 2019"), ("T2", "May 15, 2019")]).select(
        "title", X.lenient_date("release_text").alias("release_date"))
    span = E.date_span(E.attach_dates(titles, dates)).collect()[0]
    assert (span.days, span.weeks) == (14, 2.0)
    empty = release_date_rows(spark, [])
    assert empty.count() == 0
    none = E.date_span(E.attach_dates(titles, empty.select(
        "title", X.lenient_date("release_text").alias("release_date")))).collect()[0]
    assert none.days is None and none.weeks is None


def test_pages_table_fields(spark, sf001):
    from marquee.plans.catalog import QUERIES

    df = QUERIES["page_field"](spark, sf001)
    assert df.count() == 250 and df.filter(F.col("value").isNull()).count() == 0


def test_keep_values_in_list_or_table(spark, sf001):
    from marquee.plans.catalog import QUERIES

    clean = QUERIES["clean_catalog"](spark, sf001)
    listed = E.keep_values_in(clean, "countries", E.COMPARED_COUNTRIES)
    table = spark.createDataFrame([(c,) for c in E.COMPARED_COUNTRIES], "name string")
    joined = E.keep_values_in(clean, "countries", table, "name")
    assert listed.count() == joined.count() == QUERIES["filter_in_list"](spark, sf001).count()
    assert joined.columns == clean.columns
