"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.sources.files import scratch_path

# Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as zstd Parquet under the shared folder and read it back.

    Cuts lineage at files that every executor can read, so a lost executor
    costs a re-read and row identities assigned before the write are fixed.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``written``, dealt by ``key`` and in buckets of it: joins on it move the other side only.

    There are as many buckets as shuffle partitions, at most as many as Spark allows.  The session's
    catalog keeps a table that points at the files, under a name of its own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = min(shuffle_partitions(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    out = df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", path)
    out.bucketBy(buckets, key).saveAsTable(table)
    return spark.read.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def code_points(column: str) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def prefix_sum(df: DataFrame, keys: list[str], lane: str, order: list, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``keys`` in (lane, order) order.

    A key may hold any share of the rows: its rows are summed lane by lane, and
    only one row per (key, lane) meets in the window over lanes.  The number
    of lanes per key is the caller's bound.  Keys and lanes are not null.  The
    join is never a broadcast: rows made by ``explode`` are not in Spark's size estimates.
    """
    within = Window.partitionBy(*keys, lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, lane).agg(F.sum(value).alias("_lane_sum"))
    sums = sums.select(*keys, lane, F.coalesce(F.sum("_lane_sum").over(before), F.lit(0)).alias("_lane_start"))
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (
        local.join(sums.hint("merge"), [*keys, lane])
        .withColumn(out, F.col("_lane_start") + F.col("_local"))
        .drop("_lane_start", "_local")
    )


def label_totals(df: DataFrame, label: str, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of equal ``label`` (nulls together; null values count 0), at
    most the largest long.

    Labels that hold more than a shuffle partition's share of the rows (so at most as many as there are
    partitions) are split: their rows go to as many salts as they hold shares, and
    their one total is sent to each.  All other labels meet their total under salt 0.
    ``df`` reads a written table, so rows keep their salts when a task runs again.
    """
    spark = df.sparkSession
    totals = df.groupBy(label).agg(
        F.least(F.coalesce(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(0)), F.lit(2**63 - 1).cast("decimal(38,0)"))
        .cast("long").alias(out), F.count("*").alias("_rows"))
    totals = written(totals, "label_totals")
    share = (totals.agg(F.sum("_rows")).first()[0] or 0) // shuffle_partitions(spark) + 1
    salts = F.ceil(F.col("_rows") / share).cast("int")
    hot = totals.filter(F.col("_rows") > share).select(F.col(label).alias("_hot"), salts.alias("_salts"))
    dealt = df.join(F.broadcast(hot), F.col(label).eqNullSafe(F.col("_hot")), "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.expr("int(monotonically_increasing_id() % _salts)"), F.lit(0)))
    each = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(F.col(label).alias("_label"), out, "_salt")
    met = dealt.withColumnRenamed("_salt", "_own").join(
        each.hint("merge"), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt")))
    return met.select(*df.columns, out)
