"""Schemas of the raw and the clean title catalogue.

The raw catalogue is headerless, tab-separated text with twelve positional
columns.  Every raw column is read as text: dirty data would otherwise make the
inferred types depend on the file contents.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Positional column -> our column name, in file order.
POSITIONAL_NAMES = {
    "_c0": "title_id",
    "_c1": "kind",
    "_c2": "title",
    "_c3": "directors",
    "_c4": "performers",
    "_c5": "countries",
    "_c6": "added_on",
    "_c7": "release_year",
    "_c8": "rating",
    "_c9": "duration",
    "_c10": "genres",
    "_c11": "synopsis",
}

RAW_COLUMNS = list(POSITIONAL_NAMES.values())

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

POSITIONAL_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in POSITIONAL_NAMES]
)

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("title_id", T.IntegerType(), True),
        T.StructField("kind", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("directors", T.StringType(), True),
        T.StructField("performers", T.StringType(), True),
        T.StructField("countries", T.StringType(), True),
        T.StructField("added_on", T.DateType(), True),
        T.StructField("release_year", T.IntegerType(), True),
        T.StructField("rating", T.StringType(), True),
        T.StructField("duration", T.IntegerType(), True),
        T.StructField("genres", T.StringType(), True),
        T.StructField("synopsis", T.StringType(), True),
        T.StructField("duration_min", T.IntegerType(), True),
        T.StructField("seasons", T.IntegerType(), True),
    ]
)

CLEAN_COLUMNS = CLEAN_SCHEMA.fieldNames()

# Side table of release dates (title, date text), as built from fetched pages.
RELEASE_DATES_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType(), True),
        T.StructField("release_text", T.StringType(), True),
    ]
)

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType(), True),
        T.StructField("status", T.IntegerType(), True),
        T.StructField("html", T.StringType(), True),
    ]
)
