"""Catalogue inputs derived from the driver's parquet tables.

The catalogue the analysis was written for is not shipped with the data; a
dirty catalogue with the same twelve text columns and the same kinds of dirt is
derived from ``orders`` (one title per order), so that it grows with the
tables.  The derivation is a pure projection: no shuffle, and it inherits the
scan's partitioning and pushdown.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Fixed value: how dates are written in the catalogue text ("January 3, 2019").
CATALOG_DATE_FORMAT = "MMMM d, yyyy"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# The derivation of the dirty catalogue and of the fetched pages
# (FIXTURES sections 2 and 4), as Spark SQL expressions over ``orders``.
# ``k`` is the order key, ``c`` the customer key, ``d`` the order date, ``r`` 30 days later.
_FIRST_COUNTRY = (
    "CASE k % 4 WHEN 0 THEN 'United States' WHEN 1 THEN 'India' WHEN 2 THEN 'Spain' "
    "ELSE 'France' END"
)
_SECOND_COUNTRY = "CASE k % 3 WHEN 0 THEN 'Mexico' WHEN 1 THEN 'India' ELSE 'France' END"
_DATE_TEXT = f"date_format(d, '{CATALOG_DATE_FORMAT}')"
RAW_CATALOG_EXPRS = {
    "title_id": "CASE WHEN k % 53 = 0 THEN 'n/a' WHEN k % 59 = 0 THEN CAST(k % 9999 AS STRING) "
                "WHEN k % 41 = 0 THEN CAST(80000000 + k - 1 AS STRING) "
                "ELSE CAST(80000000 + k AS STRING) END",
    "kind": "CASE WHEN k % 47 = 0 THEN 'William Wyler' WHEN k % 3 = 0 THEN 'TV Show' "
            "ELSE 'Movie' END",
    "title": "CASE WHEN k % 61 = 0 THEN concat('HTTPS://x.example/', CAST(k AS STRING)) "
             "WHEN k % 67 = 0 THEN CAST(k AS STRING) WHEN k % 101 = 0 THEN 'January 31, 2019' "
             "ELSE concat('Title ', CAST(k AS STRING)) END",
    "directors": "CASE WHEN k % 11 = 0 THEN NULL "
                 "WHEN k % 71 = 0 THEN concat('a', CAST(k AS STRING), '@mail.example') "
                 "ELSE concat('Director ', CAST(k % 97 AS STRING)) END",
    "performers": "CASE WHEN k % 23 = 0 THEN NULL WHEN k % 73 = 0 THEN '12345' "
                  "ELSE concat('Actor ', CAST(c % 50 AS STRING), ', Actor ', CAST(k % 37 AS STRING)) END",
    "countries": f"CASE WHEN k % 19 = 0 THEN NULL "
                 f"WHEN k % 4 = 0 THEN concat({_FIRST_COUNTRY}, ', ', {_SECOND_COUNTRY}) "
                 f"ELSE {_FIRST_COUNTRY} END",
    "added_on": f"CASE WHEN k % 79 = 0 THEN '2019-13-45' "
                f"WHEN k % 5 = 0 THEN concat(' ', {_DATE_TEXT}, ' ') ELSE {_DATE_TEXT} END",
    "release_year": "CASE WHEN k % 83 = 0 THEN 'abc' ELSE CAST(1990 + k % 30 AS STRING) END",
    "rating": "CASE WHEN k % 89 = 0 THEN '90 min' WHEN k % 103 = 0 THEN '2 Seasons' "
              "WHEN k % 13 = 0 THEN 'junk' WHEN k % 2 = 0 THEN ' TV-MA' ELSE 'PG-13' END",
    "duration": "CASE WHEN k % 43 = 0 THEN 'Dramas' "
                "WHEN k % 3 = 0 THEN (CASE WHEN k % 7 = 0 THEN '1 Season' "
                "ELSE concat(CAST(k % 7 + 1 AS STRING), ' Seasons') END) "
                "ELSE concat(CAST(60 + k % 120 AS STRING), ' min') END",
    "genres": "CASE WHEN k % 29 = 0 THEN NULL WHEN k % 2 = 0 THEN 'Dramas, Music' "
              "ELSE 'Comedies' END",
    "synopsis": "CASE WHEN k % 222 = 0 THEN '' ELSE concat("
                "CASE WHEN k % 6 = 1 THEN 'A MUSIC story ' ELSE 'A plain story ' END, CAST(k AS STRING), "
                "CASE WHEN k % 211 = 0 THEN concat(chr(10), '\"told\"', chr(9), 'in two lines') ELSE '' END) END",
}
RELEASE_PAGES_EXPRS = {
    "title": "concat('Title ', CAST(k AS STRING))",
    "status": "CASE WHEN k % 2 = 0 THEN 0 WHEN k % 17 = 0 THEN 404 ELSE 200 END",
    "html": "CASE WHEN k % 2 = 0 THEN NULL WHEN k % 31 = 0 THEN '<html><p>no date</p></html>' "
            "WHEN k % 7 = 1 THEN concat('<html><span data-class=\"release\">WRONG</span>"
            "<span id=r class=\"release\">', date_format(r, 'MMMM'), ' <b class=\"day\">', "
            "date_format(r, 'd'), '</b>, <i>', date_format(r, 'yyyy'), '</i></span></html>') "
            "WHEN k % 7 = 2 THEN concat('<HTML><SPAN CLASS=''x''>-</SPAN><SPAN ID=\"r\" CLASS = ''a release''>', "
            f"date_format(r, '{CATALOG_DATE_FORMAT}'), '&nbsp;</SPAN></HTML>') "
            "WHEN k % 7 = 3 THEN concat('<span class=\"release\"><a href=\"/r\">', "
            f"date_format(r, '{CATALOG_DATE_FORMAT}'), '</a></span>') "
            "ELSE concat('<html><span class=\"x\">-</span><span class=\"a release b\"> ', "
            f"date_format(r, '{CATALOG_DATE_FORMAT}'), "
            "' </span><span class=\"release\">January 1, 1900</span></html>') END",
}


def raw_catalog_from_orders(orders: DataFrame) -> DataFrame:
    """Dirty catalogue, one row per order; all twelve columns are text.

    Written as SQL expressions: one projection, parsed once in the JVM.
    """
    keyed = orders.selectExpr("o_orderkey AS k", "o_custkey AS c", "o_orderdate AS d")
    return keyed.selectExpr(*[f"{e} AS {name}" for name, e in RAW_CATALOG_EXPRS.items()])


def release_pages_from_orders(orders: DataFrame) -> DataFrame:
    """Already-fetched release-info pages: (title, status, html).

    Stands in for the live pages the analysis downloads one by one on the
    driver; here they are a table, so extraction runs on the executors.  Titles
    whose page was never fetched have status 0 and no text.
    """
    keyed = orders.selectExpr("o_orderkey AS k", "date_add(to_date(o_orderdate), 30) AS r")
    return keyed.selectExpr(*[f"{e} AS {name}" for name, e in RELEASE_PAGES_EXPRS.items()])


def _dealt(orders: DataFrame, partitions: int | None) -> DataFrame:
    return orders.repartition(partitions, "o_orderkey") if partitions else orders


def raw_catalog(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """The dirty catalogue.  ``partitions`` deals the three narrow columns it is derived from out to so
    many tasks by order key; it is the caller's choice for a table of few row groups, and
    never taken from the table.  A table of many files is read without it."""
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return raw_catalog_from_orders(_dealt(orders, partitions))


def release_pages(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """The fetched pages; ``partitions`` as for ``raw_catalog``."""
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return release_pages_from_orders(_dealt(orders, partitions))
