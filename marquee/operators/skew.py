"""Joins whose keys may be hot, split by counts and not by what the session adapts to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FINE = 16  # shares that a partition's fair part of the rows is cut into


def hot_keys(df: DataFrame, on: str, shares: int) -> DataFrame:
    """(_hot, _salts): the values of ``on`` that hold more than one ``shares``-th of the rows, fewer than
    ``shares`` of them, and how many such shares each holds, rounded up.

    Counted within every task first, so a hot key leaves a task as one row; NULL, which
    joins with nothing, counts as a key like any other.
    """
    counts = df.groupBy(F.col(on).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") * shares > total).select(
        "_hot", F.ceil(F.col("_n") * shares / total).cast("int").alias("_salts")
    )


def split_left_join(left: DataFrame, right: DataFrame, on: str, partitions: int | None = None) -> DataFrame:
    """``left.join(right, on, "left")`` with hot keys of ``left`` dealt out; ``right`` holds at most one row a key.

    A share is a ``FINE``-th of what each of ``partitions`` (default: the session's shuffle partitions) would
    read if rows were spread evenly.  A key with more than a share is hot: its left rows get salts by a hash of
    the row, as many as it holds shares, and its right row is sent to each.  All other keys have salt 0.
    The hot keys are broadcast: they are fewer than there are shares, ``FINE * partitions``, and all their salts
    fewer than twice that.  Nothing depends on adaptive execution.  Rows that are equal in
    all columns have one salt, so copies of whole rows are not spread.
    """
    if not partitions:
        partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(left, on, FINE * partitions))
    salts = F.coalesce("_salts", F.lit(1))
    same = F.col(on).eqNullSafe(F.col("_hot"))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    dealt = left.join(hot, same, "left").withColumn("_salt", F.pmod(row, salts).cast("int"))
    each = right.join(hot, same, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    joined = dealt.drop("_hot", "_salts").join(each.drop("_hot", "_salts"), [on, "_salt"], "left")
    return joined.drop("_salt")
