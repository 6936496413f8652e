"""Exploration operators over the clean catalogue.

Design notes for scale:

* Means are ``groupBy().agg(avg)``: partial aggregation runs map-side, so a
  country (or combination) that holds a third of all titles costs one buffer
  row per map task, not a hot reducer.
* ``compare_country`` answers "mean by combination vs. mean by participation"
  with one exploded aggregate instead of two aggregates and a join.
* The top performer is a one-row scalar subquery, not a driver ``collect()``;
  the plan stays lazy and the filter on it runs on the executors.
* Nothing here broadcasts explicitly: Spark broadcasts a side only where its
  estimated or, later, its measured size is below the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import exprs as X
from marquee.operators.skew import split_left_join

COMPARED_COUNTRIES = ("United States", "France", "India", "Spain")  # fixed value


def avg_by(
    df: DataFrame,
    key: str,
    value: str = "duration_min",
    alias: str = "mean_minutes",
    digits: int = 2,
) -> DataFrame:
    """(key, mean of value rounded to ``digits``); NULL values are ignored."""
    return df.groupBy(key).agg(F.round(F.avg(value), digits).alias(alias))


def explode_items(df: DataFrame, list_col: str, alias: str, sep: str = ", ") -> DataFrame:
    """One row per element of a delimited list column; NULL lists give no row."""
    return df.withColumn(alias, F.explode(F.split(F.col(list_col), sep)))


def avg_by_item(
    df: DataFrame,
    list_col: str,
    item: str,
    value: str = "duration_min",
    alias: str = "mean_minutes",
    sep: str = ", ",
    digits: int = 2,
) -> DataFrame:
    """Mean of ``value`` over the titles each list element takes part in."""
    exploded = explode_items(df.select(list_col, value), list_col, item, sep)
    return avg_by(exploded, item, value, alias, digits)


def formatted(df: DataFrame, mean_col: str, alias: str = "mean_text") -> DataFrame:
    """Replace a mean-minutes column by its ``N min M sec`` text."""
    return df.withColumn(alias, X.minutes_text(mean_col)).drop(mean_col).select(
        *[c for c in df.columns if c != mean_col], alias
    )


def compare_country(
    df: DataFrame,
    countries=None,
    as_text: bool = False,
    value: str = "duration_min",
    sep: str = ", ",
    digits: int = 2,
    participation_value: str | None = None,
) -> DataFrame:
    """Per country: mean over titles made by that country alone (the whole
    countries text equals it) and mean over titles it takes part in.

    Equivalent to joining ``avg_by(countries)`` with ``avg_by_item(countries)``
    on combination = country (a combination equal to a single element cannot
    contain the separator, so its titles explode into exactly that element),
    but computed with one shuffle and no join.  The second mean may be over
    another column (``participation_value``).
    """
    other = participation_value or value
    columns = list(dict.fromkeys(["countries", value, other]))
    exploded = explode_items(df.select(*columns), "countries", "country", sep)
    if countries is not None:
        exploded = exploded.filter(F.col("country").isin(list(countries)))
    alone = F.col("countries") == F.col("country")
    out = (
        exploded.groupBy("country")
        .agg(
            F.round(F.avg(F.when(alone, F.col(value))), digits).alias("combination_mean"),
            F.round(F.avg(other), digits).alias("participation_mean"),
            F.max(alone).alias("_alone"),
        )
        .filter(F.col("_alone"))
        .drop("_alone")
    )
    if as_text:
        out = out.select(
            "country",
            X.minutes_text("combination_mean").alias("combination_text"),
            X.minutes_text("participation_mean").alias("participation_text"),
        )
    return out


def compare_country_join(df: DataFrame, countries=None, value: str = "duration_min") -> DataFrame:
    """The same comparison written as the two aggregates and an inner join."""
    combo = avg_by(df, "countries", value, "combination_mean")
    part = avg_by_item(df, "countries", "country", value, "participation_mean")
    if countries is not None:
        combo = combo.filter(F.col("countries").isin(list(countries)))
        part = part.filter(F.col("country").isin(list(countries)))
    c = combo.alias("c")
    p = part.alias("p")
    return c.join(p, F.col("c.countries") == F.col("p.country"), "inner").select(
        F.col("p.country").alias("country"),
        F.col("c.combination_mean").alias("combination_mean"),
        F.col("p.participation_mean").alias("participation_mean"),
    )


def keep_values_in(df: DataFrame, column: str, values, values_column: str | None = None) -> DataFrame:
    """Rows whose ``column`` is one of ``values``: a list (``isin``, pushed
    into the scan where it can be) or a DataFrame (left-semi join; AQE
    broadcasts the values only if their runtime size passes its threshold)."""
    if isinstance(values, DataFrame):
        other = values_column or column
        right = values.select(F.col(other).alias("_value"))
        return df.join(right, F.col(column) == F.col("_value"), "left_semi")
    return df.filter(F.col(column).isin(list(values)))


def music_titles(df: DataFrame, word: str = "music", min_minutes: int = 90) -> DataFrame:
    """Films whose synopsis mentions ``word`` (any case) and longer than
    ``min_minutes``."""
    return df.filter(
        (F.col("kind") == "Movie")
        & F.lower(F.col("synopsis")).contains(word.lower())
        & (F.col("duration") > min_minutes)
    )


def frequent_items(
    df: DataFrame, list_col: str = "performers", item: str = "performer", sep: str = ", "
) -> DataFrame:
    """(item, appearances): how many list entries name each item."""
    exploded = explode_items(df.select(list_col), list_col, item, sep)
    return exploded.groupBy(item).agg(F.count(item).alias("appearances"))


def top_items(freq: DataFrame, n: int, item: str = "performer", count: str = "appearances") -> DataFrame:
    """The ``n`` most frequent items, ties broken by item name (top-k)."""
    return freq.orderBy(F.desc(count), F.asc(item)).limit(n)


def top_performer(df: DataFrame) -> DataFrame:
    """One row (performer, appearances): the most frequent performer."""
    return top_items(frequent_items(df), 1)


def performer_titles(df: DataFrame, performer, exact: bool = False, sep: str = ", ") -> DataFrame:
    """Titles whose performers text names ``performer``.

    ``performer`` is a string or a Column (e.g. a scalar subquery).  By default
    the test is a substring test, so a name inside a longer name also matches;
    ``exact=True`` tests list membership instead.
    """
    name = F.lit(performer) if isinstance(performer, str) else performer
    if exact:
        cond = F.array_contains(F.split(F.col("performers"), sep), name)
    else:
        cond = F.col("performers").contains(name)
    return df.filter(cond)


def top_performer_name(df: DataFrame) -> Column:
    """Scalar subquery column holding the top performer's name."""
    return top_performer(df).select("performer").scalar()


def extract_field(
    pages: DataFrame,
    tag: str,
    css_class: str,
    key: str = "title",
    html: str = "html",
    status: str | None = "status",
    alias: str = "value",
) -> DataFrame:
    """(key, text of the first ``tag`` element with class ``css_class``).

    NULL when the page is not a 200 or no element matches.  Runs as a
    projection over the pages table; no page goes through the driver.
    """
    text = X.first_element_text(html, tag, css_class)
    if status is not None:
        text = F.when(F.col(status) == 200, text)
    return pages.select(key, text.alias(alias))


def release_dates(
    pages: DataFrame, tag: str = "span", css_class: str = "release", fmt: str = X.DATE_FORMAT
) -> DataFrame:
    """(title, release_date): one parsed date per title (the earliest)."""
    fields = extract_field(pages, tag, css_class, alias="release_text")
    return fields.groupBy("title").agg(
        F.min(X.lenient_date("release_text", fmt)).alias("release_date")
    )


def attach_dates(titles: DataFrame, dates: DataFrame, on: str = "title") -> DataFrame:
    """Left join of titles with a table holding at most one row per ``on``.  One title may
    hold any share of the rows: its rows are salted (``skew.split_left_join``)."""
    return split_left_join(titles, dates, on)


def date_span(df: DataFrame, date_col: str = "release_date") -> DataFrame:
    """(first_date, last_date, days, weeks) over a date column; NULL when the
    column holds no date."""
    span = df.agg(F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))
    days = F.datediff("last_date", "first_date")
    return span.select("first_date", "last_date", days.alias("days"), (days / 7.0).alias("weeks"))


def item_array(df: DataFrame, col: str = "genres", alias: str = "genre_array", sep: str = ",", trim: bool = False) -> DataFrame:
    return df.withColumn(alias, X.item_array(col, sep, trim))


def coproduction_counts(df: DataFrame, col: str = "countries", sep: str = ",") -> DataFrame:
    """One row: titles made by one country (solo) and by several."""
    n = X.item_count(col, sep)
    return df.agg(
        F.count_if(n == 1).alias("solo_titles"), F.count_if(n > 1).alias("coproduced_titles")
    )
