"""Inspection operators: null profile, schema report, preview, row counts.

Results are small DataFrames, never driver-side prints: the caller decides
whether to show, collect or write them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def null_counts(df: DataFrame) -> DataFrame:
    """One row, one bigint per column: how many NULLs it holds (0 on empty
    input).  A single partial + final aggregate over the whole table."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, nulls), one row per column of ``df``."""
    return null_counts(df).unpivot([], df.columns, "column_name", "nulls")


def schema_report(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, non_null): the schema, and how many
    rows hold a value in each column (one aggregate over the table)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def preview(df: DataFrame, key: str | list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows by ``key`` (a top-k, not a full sort)."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*keys).limit(n)


def row_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) for each named DataFrame."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Text forms of the types that delimited text is tested for, narrowest first, each with the value
# that must exist besides; a value of a type is one of every wider number or time type too.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DAY = r"\d{4}-\d{2}-\d{2}"
_FORMS = (
    ("int", r"^[+-]?\d+$", "try_cast(`{c}` AS INT)"),
    ("bigint", r"^[+-]?\d+$", "try_cast(`{c}` AS BIGINT)"),
    ("double", _NUMBER, "try_cast(`{c}` AS DOUBLE)"),
    ("date", rf"^{_DAY}$", "try_cast(`{c}` AS DATE)"),
    ("timestamp", rf"^{_DAY}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d{{1,6}})?)?(Z|[+-]\d{{2}}:\d{{2}})?)?$", "try_cast(`{c}` AS TIMESTAMP)"),
    ("boolean", r"^(?i)(true|false)$", "try_cast(`{c}` AS BOOLEAN)"),
)


def infer_types(text: DataFrame) -> DataFrame:
    """(position, column_name, data_type, non_null, fits, counter_example), one row a text column.

    The type is the narrowest that all values of the column have: int, bigint, double; date, timestamp;
    boolean; else (or without any value) string.  ``fits`` counts the values of each type, and
    ``counter_example`` is the least value that the most fitting type does not have (NULL where all fit).
    One aggregate over the table, whose counts merge: partial in every task, one row after the shuffle.
    """
    sums = []
    for i, c in enumerate(text.columns):
        value = F.col(f"`{c}`")
        sums.append(F.count(value).alias(f"n{i}"))
        for kind, form, cast in _FORMS:
            fits = F.coalesce(value.rlike(form) & F.expr(cast.format(c=c.replace("`", "``"))).isNotNull(), F.lit(False))
            sums.append(F.count_if(fits).alias(f"{kind}{i}"))
            sums.append(F.min(F.when(~fits, value)).alias(f"not_{kind}{i}"))
    rows = []
    for i, c in enumerate(text.columns):
        n, found = F.col(f"n{i}"), [kind for kind, _, _ in _FORMS]
        kind = F.lit("string")
        for name in reversed(found):
            kind = F.when((n > 0) & (F.col(f"{name}{i}") == n), name).otherwise(kind)
        fits = F.create_map(*[x for name in found for x in (F.lit(name), F.col(f"{name}{i}"))])
        best = F.greatest(*[F.col(f"{name}{i}") for name in found])
        example = F.lit(None).cast("string")
        for name in reversed(found):
            example = F.when(F.col(f"{name}{i}") == best, F.col(f"not_{name}{i}")).otherwise(example)
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column_name"), kind.alias("data_type"),
            n.alias("non_null"), fits.alias("fits"), example.alias("counter_example")))
    return text.agg(*sums).select(F.inline(F.array(*rows)))
