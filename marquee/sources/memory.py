"""Small side tables given as rows in driver memory (S4).

Always with an explicit schema: an empty list cannot have its types
inferred, and inference would make the types depend on the values.  Meant for
small, fixed inputs such as a hand-made list of release dates; anything that
grows with the data should be read as a table instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from marquee.sources.schema import RELEASE_DATES_SCHEMA


def inline_rows(spark: SparkSession, rows, schema: StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def release_date_rows(spark: SparkSession, rows) -> DataFrame:
    """(title, release_text) rows, e.g. dates noted by hand for a few titles."""
    return inline_rows(spark, rows, RELEASE_DATES_SCHEMA)
