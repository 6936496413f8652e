"""Clustered Parquet export: files sorted by a key, a manifest of each file's key range, and
replacement of the partitions that an export touches.

An export writes its files into a folder of their own and then a manifest that names them beside the
files of all partitions it did not touch.  The newest manifest that Spark has committed is the
table, so readers see an export whole or not at all, and one that was killed leaves nothing but unnamed files.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.sources.files import committed_folders

ROWS_PER_FILE = 1_000_000
_NONE = "null"  # folder of the partition without a value; others are written as "=value"


def _manifests(path: str) -> str:
    return os.path.join(path, "manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, partition, rows, low, high, table_schema) of the newest committed export; None before the first.
    ``low`` and ``high`` bound the sort key of the file, NULL where it holds no key.  One row names no file but
    the table's columns."""
    versions = committed_folders(spark, _manifests(path), "version")
    return spark.read.parquet(os.path.join(_manifests(path), f"version={versions[-1]}")) if versions else None


def write_clustered(
    df: DataFrame, path: str, partition: str, sort_by: str, rows_per_file: int = ROWS_PER_FILE, partitions: int | None = None
) -> int:
    """Write ``df`` under ``path`` and return the version of its manifest.

    Rows are dealt by ranges of (partition, sort key, hash of the row), which Spark takes from a sample, so neither a
    partition nor a key that holds a third of the rows is one task's; rows equal in all columns stay together.  No file has more than
    ``rows_per_file`` rows.  Partitions that occur in ``df`` replace those of earlier exports, all others
    stay; an empty ``df`` replaces nothing.  The columns must be those of earlier exports.
    """
    spark = df.sparkSession
    old = manifest(spark, path)
    schema = df.schema.json()
    if old is not None and _names(old.filter("file IS NULL").first().table_schema) != _names(schema):
        raise ValueError("the columns differ from those exported before")
    label = F.coalesce(F.concat(F.lit("="), F.col(partition).cast("string")), F.lit(_NONE))
    data = os.path.join(path, "data", uuid.uuid4().hex)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    dealt = df.withColumn("_partition", label).withColumn("_row", hashed)
    dealt = dealt.repartitionByRange(partitions, "_partition", sort_by, "_row")
    dealt = dealt.sortWithinPartitions("_partition", sort_by).drop("_row")
    dealt.write.option("maxRecordsPerFile", rows_per_file).partitionBy("_partition").parquet(data)
    read = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_partition", T.StringType())])).parquet(data)
    # Spark names files as URIs here and reads them by their plain names.
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    new = read.groupBy(name.alias("file"), F.col("_partition").alias("partition")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(sort_by).alias("low"), F.max(sort_by).alias("high")
    )
    new = new.withColumn("table_schema", F.lit(None).cast("string"))
    versions = committed_folders(spark, _manifests(path), "version")
    version = versions[-1] + 1 if versions else 0
    target = os.path.join(_manifests(path), f"version={version}")
    if old is None:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields if f.name != "table_schema"]
        new = new.unionByName(spark.range(1).select(*none, F.lit(schema).alias("table_schema")))
    else:
        # One row a file on either side.
        new = old.join(new.select("partition").distinct(), "partition", "left_anti").select(new.columns).unionByName(new)
    new.coalesce(1).write.mode("overwrite").parquet(target)
    return version


def _names(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(json.loads(schema)).fields]


def read_clustered(spark: SparkSession, path: str, sort_by: str, low=None, high=None) -> DataFrame:
    """The rows whose ``sort_by`` is from ``low`` to ``high``, both included, None leaving a side open; without bounds all rows,
    those without a key too.  Opens only files whose key range meets the bounds.

    The names of those files come to the driver, as those of any table that Spark reads do.
    """
    files = manifest(spark, path)
    if files is None:
        raise ValueError(f"nothing was exported to {path}")
    schema = T.StructType.fromJson(json.loads(files.filter("file IS NULL").first().table_schema))
    files = files.filter("file IS NOT NULL")
    if low is not None:
        files = files.filter(F.col("high") >= F.lit(low))
    if high is not None:
        files = files.filter(F.col("low") <= F.lit(high))
    names = [r.file for r in files.select("file").collect()]
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    if low is not None:
        rows = rows.filter(F.col(sort_by) >= F.lit(low))
    return rows if high is None else rows.filter(F.col(sort_by) <= F.lit(high))
