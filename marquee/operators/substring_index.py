"""A stored n-gram index over a text column, for substring search without reading every text.

Rows are dealt into blocks of at most 32,768 and numbered within them.  For every run of one, two or
three characters and every block the index stores a bitmap of the rows that hold it.  A search
intersects the bitmaps of the name's runs, reads the rows left over, and tests the texts themselves.
Names of one or two characters have a bitmap of their own.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
BITS = 1 << 15  # rows a bitmap covers (fixed by Spark's bitmap functions)
FILL = BITS // 2  # rows a block is meant to get; blocks that get more than BITS go on in a further bitmap
SHELVES = 256  # folders that the bitmaps are dealt to by their run

LISTS = "_gram string, _block bigint, _rows binary, _shelf int"


def grams(name: str) -> list[str]:
    """The runs whose bitmaps a search for ``name`` intersects; none for the empty name."""
    size = min(GRAM, len(name))
    return sorted({name[i : i + size] for i in range(len(name) - size + 1)}) if size else []


def _runs(text: Column) -> Column:
    """All distinct runs of one to GRAM characters."""

    def of(size: int) -> Column:
        last = F.length(text) - size + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))

    return F.array_distinct(F.concat(*[of(size) for size in range(1, GRAM + 1)]))


def _shelf(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHELVES)).cast("int")


def build(df: DataFrame, text: str, path: str, partitions: int | None = None) -> str:
    """Write the rows of ``df`` and the index of its column ``text`` under ``path``.

    Rows are dealt to blocks by a hash of their number, so equal rows are dealt apart; a common run leaves
    every task as one bitmap a block.  Rows with a NULL text are stored and never found.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Numbers are fixed by being written before anything reads them.
    df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(os.path.join(path, "numbered"))
    numbered = spark.read.parquet(os.path.join(path, "numbered"))
    total = numbered.count()
    blocks = max(1, -(-total // FILL))
    dealt = numbered.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_row")) - 1
    dealt = dealt.withColumn("_place", place).drop("_row")
    # A block of more than BITS rows (far more than hashing gives) goes on under a further number.
    dealt = dealt.withColumn("_block", F.col("_block") + blocks * F.floor(F.col("_place") / BITS))
    dealt = dealt.withColumn("_place", (F.col("_place") % BITS).cast("int"))
    dealt.write.parquet(os.path.join(path, "rows"))
    rows = spark.read.parquet(os.path.join(path, "rows"))
    held = rows.select("_block", "_place", F.explode(_runs(F.col(text))).alias("_gram"))
    lists = held.groupBy("_gram", "_block").agg(F.bitmap_construct_agg("_place").alias("_rows"))
    lists = lists.withColumn("_shelf", _shelf(F.col("_gram")))
    ordered = lists.repartitionByRange(partitions, "_shelf", "_gram", "_block").sortWithinPartitions("_shelf", "_gram")
    ordered.write.partitionBy("_shelf").parquet(os.path.join(path, "lists"))
    return path


def lists_of(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The stored bitmaps that a search for ``names`` reads: their folders by partition, their runs by a
    filter that is pushed into the scan."""
    wanted = sorted({g for name in names for g in grams(name)})
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("g")) if wanted else None
    shelves = sorted({r.s for r in one.select(_shelf(F.col("g")).alias("s")).collect()}) if wanted else []
    # With no rows there are no folders that a schema could be read from.
    lists = spark.read.schema(LISTS).parquet(os.path.join(path, "lists"))
    return lists.filter(F.col("_shelf").isin(shelves) & F.col("_gram").isin(wanted))


def search(spark: SparkSession, path: str, text: str, names: list[str]) -> DataFrame:
    """(name, all columns of the indexed table) for every row whose ``text`` contains a name; repeated
    names count once, the empty name is in every text that is not NULL.

    ``names`` is the caller's list; its runs are broadcast.  The rows that the bitmaps leave over are tested
    by their texts, so the result is that of a scan.
    """
    names = sorted(set(names))
    rows = spark.read.parquet(os.path.join(path, "rows"))
    own = [c for c in rows.columns if c not in ("_block", "_place")]
    asked = [(name, g, len(grams(name))) for name in names for g in grams(name)]
    asked = spark.createDataFrame(asked, "_name string, _wanted string, _n int")
    lists = lists_of(spark, path, names)
    near = lists.join(F.broadcast(asked), F.col("_gram") == F.col("_wanted"))
    both = near.groupBy("_name", "_block").agg(
        F.bitmap_and_agg("_rows").alias("_rows"), F.count(F.lit(1)).alias("_has"), F.max("_n").alias("_n")
    )
    both = both.filter((F.col("_has") == F.col("_n")) & (F.bitmap_count("_rows") > 0)).select("_name", "_block", "_rows")
    byte = F.conv(F.hex(F.substr("_rows", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    stands = F.getbit(byte, F.col("_place") % 8) == 1
    hits = rows.join(both, "_block").filter(stands & F.col(text).contains(F.col("_name")))
    found = hits.select(F.col("_name").alias("name"), *own)
    if "" in names:
        found = found.unionByName(rows.filter(F.col(text).isNotNull()).select(F.lit("").alias("name"), *own))
    return found
