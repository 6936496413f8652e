import pytest
from pyspark.sql import functions as F

# Names that operators use for columns of their own.
CLASHES = ["row", "size", "hash", "lane", "node", "n", "piece", "start", "content", "carried", "spans", "ids", "slot"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000)) + "."


@pytest.fixture(scope="session")
def dirty(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "The cat sat on the mat and looked at the other cat.", "en", "a", 51),
        (2, "The cat sat on the mat and looked at the other cat.", "en", "a", 51),
        (2, "The cat sat on the mat and looked at the other cat.", "en", "a", 51),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (None, "no id here", "en", "b", 10),
        (None, None, None, None, None),
        (5, " \t\n ", "de", "b", 4),
        (6, "one", "en", "c", 3),
        (7, "two words", "en", "c", 9),
        (8, LONG, "en", "a", len(LONG)),
        (9, LONG + " More.", "en", None, None),
        (10, "Größe und Maß über alles, nicht wahr?    Ende\x1c.", "de", "é", 40),
        (11, "12345 67 !!", "de", "\U0001f600", 11),
        (12, "a  b\n\n c <|endoftext|> d  ", "xx", "", 20),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
