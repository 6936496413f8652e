"""Column helpers against plain-Python definitions on generated text.

Each test draws a batch of values and evaluates them in one Spark job.
"""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.functions import exprs as X

TEXT = st.one_of(
    st.none(),
    st.text(alphabet="ab ,0123456789Simnaeo-:/@.", max_size=20),
    st.sampled_from(["90 min", "1 Season", "3 Seasons", " TV-MA", "PG-13", "x 90 min",
                     "https://x", "a@b.co", "May 3, 2019", "12345", "A, B", ""]),
)
SETTINGS = settings(max_examples=15, deadline=None)


def values(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "x string")


def py_extract_int(x, pattern):
    if x is None:
        return None
    m = re.search(pattern.replace("(?i)", ""), x)
    if not m:
        return None
    n = int(m.group(1))
    return n if n < 2**31 else None


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_item_count(spark, xs):
    got = [r.n for r in values(spark, xs).select(X.item_count("x").alias("n")).collect()]
    assert got == [None if x is None else x.count(",") + 1 for x in xs]


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_extract_int(spark, xs):
    df = values(spark, xs).select(
        X.extract_int("x", X.MINUTES_PATTERN).alias("m"), X.extract_int("x", X.SEASONS_PATTERN).alias("s"))
    got = [(r.m, r.s) for r in df.collect()]
    assert got == [(py_extract_int(x, X.MINUTES_PATTERN), py_extract_int(x, X.SEASONS_PATTERN)) for x in xs]


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_normalised_rating(spark, xs):
    def py(x):
        if x is None:
            return None
        if x in X.VALID_RATINGS:
            return x
        for p in (X.MINUTES_PATTERN, X.SEASONS_PATTERN):
            if re.search(p, x):
                n = py_extract_int(x, p)
                return None if n is None else str(n)
        return None

    got = [r.r for r in values(spark, xs).select(X.normalised_rating("x").alias("r")).collect()]
    assert got == [py(x) for x in xs]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.floats(min_value=0, max_value=10000, allow_nan=False)),
                min_size=1, max_size=30))
def test_minutes_text(spark, ms):
    ms = [None if m is None else round(m, 2) for m in ms]
    df = spark.createDataFrame([(m,) for m in ms], "m double")
    got = [r.t for r in df.select(X.minutes_text("m").alias("t")).collect()]

    def py(m):
        if m is None:
            return None
        whole = math.floor(m)
        frac = round((m - whole) * 60, 6)  # HALF_UP below, away from float noise
        return f"{whole} min {int(math.floor(frac + 0.5))} sec"

    assert got == [py(m) for m in ms]


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_first_token_and_arrays(spark, xs):
    df = values(spark, xs).select(
        X.first_token("x").alias("f"), X.item_array("x").alias("a"),
        X.item_array("x", trim=True).alias("t"))
    rows = df.collect()
    for x, r in zip(xs, rows):
        if x is None:
            assert r.f is None and r.a is None and r.t is None
        else:
            assert r.f == x.split(" ")[0]
            assert r.a == x.split(",")
            assert r.t == re.split(r",\s*", x)


ROWS = st.lists(
    st.tuples(st.integers(0, 5), st.one_of(st.none(), st.sampled_from(["", "a", "b", "B", "ab"])),
              st.one_of(st.none(), st.sampled_from(["x", "y", "z"]))),
    min_size=1, max_size=40)


@SETTINGS
@given(ROWS)
def test_dedupe_keeps_smallest_row_nulls_first(spark, rows):
    from marquee.operators.clean import dedupe_by_key

    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(3)
    got = {r.k: (r.a, r.b) for r in dedupe_by_key(df, "k", ["a", "b"]).collect()}

    def order(row):
        return tuple((v is not None, v or "") for v in row)

    want = {}
    for k, a, b in rows:
        if k not in want or order((a, b)) < order(want[k]):
            want[k] = (a, b)
    assert got == want


COUNTRY_ROWS = st.lists(
    st.tuples(
        st.one_of(st.none(), st.sampled_from(
            ["France", "India", "France, India", "India, France", "France, France", "", ", ",
             "France,India", "Spain, ", "Mexico"])),
        st.one_of(st.none(), st.integers(1, 300))),
    min_size=1, max_size=40)


@SETTINGS
@given(COUNTRY_ROWS)
def test_compare_country_one_pass_equals_join(spark, rows):
    from marquee.operators import explore as E

    df = spark.createDataFrame(rows, "countries string, duration_min int")
    a = sorted(tuple(r) for r in E.compare_country(df).collect())
    b = sorted(tuple(r) for r in E.compare_country_join(df).collect())
    assert a == b


def _pool(*values):
    return st.sampled_from(values)


RAW_ROWS = st.lists(
    st.tuples(
        _pool("10000001", "10000002", "10000003", "1234567", "n/a", None),
        _pool("Movie", "TV Show", "Other"),
        _pool("T", "300", "https://x", "May 3, 2019", None),
        _pool("D", "a@b.co", "12", None),
        _pool("P, Q", "P", None),
        _pool("France", "India, France", None),
        _pool("January 3, 2019", " May 1, 2020 ", "2019-13-45", None),
        _pool("1999", "abc", None),
        _pool(" TV-MA", "90 min", "junk", None),
        _pool("90 min", "2 Seasons", "Dramas", "99999999999 min", None),
        _pool("Dramas", None),
        _pool("A music story", "42", None),
    ),
    min_size=1, max_size=40)


@settings(max_examples=6, deadline=None)
@given(RAW_ROWS)
def test_funnel_equals_stage_counts(spark, rows):
    from marquee.operators import clean as C
    from marquee.sources.schema import RAW_SCHEMA

    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    funnel = {r.step: r.rows for r in C.clean_funnel(raw).collect()}
    assert funnel["raw"] == len(rows)
    stages = dict(zip(["one_per_id", *C.STEP_NAMES], C.STAGES))
    for step, stage in stages.items():
        assert funnel[step] == C.clean_until(raw, stage).count(), step
    assert funnel["genre_valid"] == C.clean_catalog(raw).count()


@settings(max_examples=8, deadline=None)
@given(RAW_ROWS)
def test_annotate_validity_equals_chain(spark, rows):
    from marquee.operators import clean as C
    from marquee.sources.schema import RAW_SCHEMA

    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    flagged = C.annotate_validity(C.clean_identity(raw)).filter("valid").drop("valid")
    chain = C.clean_catalog(raw)
    assert sorted(map(tuple, flagged.collect()), key=repr) == sorted(map(tuple, chain.collect()), key=repr)
