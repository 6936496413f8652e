"""Unit tests on small inline fixtures (FIXTURES section 5)."""

import datetime as dt

from pyspark.sql import functions as F

from marquee.functions import exprs as X
from marquee.operators import clean as C
from marquee.operators import explore as E
from marquee.operators import profile as P
from marquee.sources.schema import CLEAN_SCHEMA, RAW_COLUMNS, RAW_SCHEMA


def raw_rows(spark, column, values, **fixed):
    base = {c: None for c in RAW_COLUMNS}
    base.update(kind="Movie", title="T", directors="D", performers="P", countries="C",
                added_on="January 1, 2019", release_year="2000", rating="PG",
                duration="90 min", genres="G", synopsis="S")
    base.update(fixed)
    rows = []
    for i, v in enumerate(values):
        r = dict(base)
        if column != "title_id":
            r["title_id"] = str(10000000 + i)
        r[column] = v
        rows.append(tuple(r[c] for c in RAW_COLUMNS))
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_identity_lengths_and_signs(spark):
    ids = ["12345678", "1234567", "-1234567", "abc", "12.7", " 12345678 ", None]
    df = raw_rows(spark, "title_id", ids)
    # one row per id, so the padded copy of 12345678 collapses onto the first
    got = sorted(r.title_id for r in C.clean_identity(df).collect())
    assert got == [-1234567, 12345678]
    # without de-duplication, the padded text also passes (try_cast trims)
    kept = df.withColumn("i", X.lenient_int("title_id")).filter(
        F.col("i").isNotNull() & (F.length(F.col("i").cast("string")) == 8))
    assert kept.count() == 3


def test_identity_keeps_smallest_row(spark):
    rows = [("12345678", "Movie", "B"), ("12345678", "Movie", "A"), ("12345678", "TV Show", None)]
    df = raw_rows(spark, "title", [])
    df = spark.createDataFrame(
        [(i, k, t) + (None,) * 9 for i, k, t in rows], RAW_SCHEMA)
    got = C.clean_identity(df).collect()
    assert len(got) == 1 and got[0].title is None and got[0].kind == "TV Show"


def test_text_and_title_patterns(spark):
    values = ["https://a", "HTTP://a", "a@b.co", "300", "May 3, 2019", "Ana", None]
    df = raw_rows(spark, "directors", values)
    assert [r.directors for r in C.clean_text(df).collect()] == ["Ana"]
    kept_keep = sorted((r.directors or "") for r in C.clean_text(df, null_policy="keep").collect())
    assert kept_keep == ["", "Ana"]
    tdf = raw_rows(spark, "title", values)
    assert sorted(r.title for r in C.clean_title(tdf).collect()) == ["300", "Ana"]


def test_duration(spark):
    values = ["90 min", "1 Season", "3 Seasons", "x 90 min", "90 min x", "Dramas", None,
              "99999999999 min"]
    out = C.clean_duration(raw_rows(spark, "duration", values)).transform(C.typed_catalog)
    got = {(r.duration_min, r.seasons, r.duration) for r in out.collect()}
    assert got == {(90, None, 90), (None, 1, 1), (None, 3, 3), (90, None, None)}


def test_added_date(spark):
    values = ["January 3, 2019", " January 03, 2019 ", "Jan 3, 2019", "2019-01-03", None]
    out = C.clean_added_date(raw_rows(spark, "added_on", values)).transform(C.typed_catalog)
    assert [r.added_on for r in out.collect()] == [dt.date(2019, 1, 3)] * 2


def test_rating(spark):
    values = [" TV-MA", "90 min", "2 Seasons", "PG 13", None, "007 min"]
    out = C.clean_rating(raw_rows(spark, "rating", values))
    assert sorted(r.rating for r in out.collect()) == ["2", "7", "90", "TV-MA"]


def test_year_range(spark):
    df = raw_rows(spark, "release_year", ["1999", "2999", "abc", "1800"])
    assert C.clean_year(df).count() == 3
    assert C.clean_year(df, min_year=1900, max_year=2100).count() == 1


def test_lists(spark):
    df = spark.createDataFrame([(v,) for v in ["A, B", "A,B", "A", "", None]], "countries string")
    exploded = E.explode_items(df, "countries", "c")
    assert exploded.count() == 2 + 1 + 1 + 1
    counts = [r.n for r in df.select(X.item_count("countries").alias("n")).collect()]
    assert counts == [2, 2, 1, 1, None]


def test_minutes_text(spark):
    df = spark.createDataFrame([(v,) for v in [99.99, 100.0, 61.5, None]], "m double")
    got = [r.t for r in df.select(X.minutes_text("m").alias("t")).collect()]
    assert got == ["99 min 59 sec", "100 min 0 sec", "61 min 30 sec", None]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], CLEAN_SCHEMA)
    prof = P.null_profile(empty).collect()
    assert len(prof) == len(CLEAN_SCHEMA.fields) and all(r.nulls == 0 for r in prof)
    span = E.date_span(empty.withColumnRenamed("added_on", "release_date")).collect()[0]
    assert span.days is None and span.weeks is None


def test_first_element_text(spark):
    html = [
        '<p><span class="x">a</span><span class="b release"> May 1, 2020 </span>'
        '<span class="release">x</span></p>',
        '<span class="released">no</span>',
        '<span class="release">A &amp; B</span>',
        None,
    ]
    df = spark.createDataFrame([(h,) for h in html], "html string")
    got = [r.v for r in df.select(X.first_element_text("html", "span", "release").alias("v")).collect()]
    assert got == ["May 1, 2020", None, "A & B", None]


def test_udf_matches_native(spark):
    from marquee.functions.udfs import count_items

    df = spark.createDataFrame([(v,) for v in ["A, B", "A,B", "A", "", None]], "countries string")
    rows = df.select(count_items("countries").alias("u"), X.item_count("countries").alias("n")).collect()
    assert all(r.u == r.n for r in rows)


def test_udf_registered_for_sql(spark):
    from marquee.functions.udfs import register_udfs

    register_udfs(spark)
    df = spark.createDataFrame([("A, B",), (None,)], "countries string")
    assert [r.n for r in df.selectExpr("count_items(countries) AS n").collect()] == [2, None]
