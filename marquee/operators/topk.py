"""Exact top-k of item counts without shuffling every distinct item.

Items are hashed into a fixed number of buckets, in two independent ways.  A bucket's count is at
least that of any item in it, so an item is out once one of its two buckets counts less
than the k-th best item does.  That k-th count is bounded from below by counting exactly the items of
a few of the fullest buckets.  Only items above the bound are then grouped by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16  # a hash; bucket counts are at most twice as many rows, whatever the data
HASHES = 2
SEEDS = 4  # fullest buckets that are counted item by item for the bound, as a multiple of k


def _bucket(item: str, which: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(which), F.col(item)), F.lit(BUCKETS)).cast("int")


def bucket_counts(items: DataFrame, item: str) -> DataFrame:
    """(_which, _bucket, _n): rows of each bucket.  Summed within every task first, so a task
    sends at most ``HASHES * BUCKETS`` rows however many distinct items it reads."""
    each = [F.struct(F.lit(i).alias("_which"), _bucket(item, i).alias("_bucket")) for i in range(HASHES)]
    both = items.select(F.explode(F.array(*each)).alias("_b")).select("_b.*")
    return both.groupBy("_which", "_bucket").agg(F.count(F.lit(1)).alias("_n"))


def _in_buckets(items: DataFrame, item: str, buckets: DataFrame, which: int) -> DataFrame:
    # At most BUCKETS pairs of integers.
    kept = F.broadcast(buckets.filter(F.col("_which") == which).select("_bucket"))
    return items.join(kept, _bucket(item, which) == F.col("_bucket"), "left_semi")


def surviving_items(items: DataFrame, n: int, item: str) -> DataFrame:
    """The rows of ``items`` whose item may be among the ``n`` most frequent; of those that are, all rows.

    With fewer than ``n`` items in the fullest buckets the bound is 0 and every row stays.
    """
    items = items.select(item).filter(F.col(item).isNotNull())
    counts = bucket_counts(items, item)
    fullest = counts.filter("_which = 0").orderBy(F.desc("_n"), "_bucket").limit(SEEDS * n)
    seeds = _in_buckets(items, item, fullest, 0).groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    best = seeds.orderBy(F.desc("_n")).limit(n)
    bound = best.agg(F.when(F.count(F.lit(1)) == n, F.min("_n")).otherwise(0)).scalar()
    full = counts.filter(F.col("_n") >= bound)
    for which in range(HASHES):
        items = _in_buckets(items, item, full, which)
    return items


def top_items_bounded(items: DataFrame, n: int, item: str, count: str = "appearances") -> DataFrame:
    """The ``n`` most frequent values of ``item`` with their counts, ties broken by value; NULL is no item.

    Equal to counting everything and taking the first ``n``.  ``items`` is read three times, each time
    narrowly: pass a stored table where computing it is dear.  Where counts are so even that the ``n``-th
    best is below an average bucket, nothing can be ruled out and every item is shuffled as usual.
    """
    if n < 1:
        raise ValueError("n must be positive")
    counted = surviving_items(items, n, item).groupBy(item).agg(F.count(F.lit(1)).alias(count))
    return counted.orderBy(F.desc(count), F.asc(item)).limit(n)
