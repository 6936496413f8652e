"""File sources and sinks: headerless delimited text (plain or gzip), Parquet.

Scratch output goes under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``).  A cluster session that names none is refused; only a
session that runs in one process gets a temporary folder.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marquee.sources.schema import POSITIONAL_NAMES, POSITIONAL_SCHEMA, RAW_SCHEMA

# Stands for an unquoted empty value while reading, so that "" stays a value.
UNQUOTED_EMPTY = "\x01"


_SCRATCH: list[str] = []
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)  # of this thread


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session in one process may leave it unset and gets a temporary folder; on
    a cluster an unset folder is an error, since executors would write to
    their own disks and the read back would be incomplete.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        if sc is None or not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="marquee-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def _context(spark: SparkSession):
    """The SparkContext, or None where the session has none (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect raises its own not-supported error
        return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder, remembered for
    ``clear_scratch``."""
    path = os.path.join(shared_dir(spark), "marquee", f"{name}-{uuid.uuid4().hex}")
    _SCRATCH.append(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, *keep: str):
    """Deletes at its end the scratch that this thread was handed out in it, except under the names ``keep``
    (these fall to the scope around it, if there is one).

    For steps whose tables nobody reads later: what is returned from it may only read tables that are kept.
    """
    token = _SCOPE.set(paths := [])
    try:
        yield
    finally:
        _SCOPE.reset(token)
        kept = [p for p in paths if os.path.basename(p).rpartition("-")[0] in keep]
        if (scope := _SCOPE.get()) is not None:
            scope.extend(kept)
        for path in paths:
            if path not in kept:
                _delete(spark, path)
                with contextlib.suppress(ValueError):  # cleared within
                    _SCRATCH.remove(path)


def _delete(spark: SparkSession, path: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def clear_scratch(spark: SparkSession) -> int:
    """Delete every scratch path handed out in this process; returns how many
    existed.  DataFrames that read them can no longer be computed."""
    removed = 0
    while _SCRATCH:
        removed += _delete(spark, _SCRATCH.pop())
    return removed


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Compute ``df`` once, write it as Parquet under the shared folder and
    return the table read back: its lineage starts at those files.

    Parquet rather than ``checkpoint()``: later jobs read only the columns
    they need, with pushed-down filters (twice as fast in our runs), and a lost
    executor costs a re-read of shared files, not a re-run of the shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def committed_folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers N, ascending, of the folders ``prefix=N`` in ``path`` that a finished Spark job wrote."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found = []
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name, _, number = status.getPath().getName().partition("=")
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name == prefix and number.isdigit() and fs.exists(done):
            found.append(int(number))
    return sorted(found)


def read_catalog_text(
    spark: SparkSession,
    path: str,
    sep: str = "\t",
    infer_schema: bool = False,
    rename: bool = True,
    multiline: bool = False,
    partitions: int | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Headerless delimited text (a file, directory or glob; ``.gz`` files are
    decompressed transparently, one task per gzip file).

    With ``infer_schema=False`` the columns are read as text with a fixed
    schema: no inference pass, and junk never changes the types.  ``columns``
    names them (default: the twelve of the catalogue).  ``multiline`` accepts line
    breaks inside quoted values, at the price that a file is one task.  A quoted empty
    value is the empty string, an unquoted one NULL.  ``partitions`` deals
    the rows out anew after reading, for few large gzip files; it is the caller's choice
    and never derived from the input.
    """
    reader = spark.read.option("sep", sep).option("header", False).option("mode", "PERMISSIVE")
    reader = reader.option("multiLine", multiline).option("emptyValue", "").option("nullValue", UNQUOTED_EMPTY)
    named = columns or (RAW_SCHEMA if rename else POSITIONAL_SCHEMA).fieldNames()
    text = T.StructType([T.StructField(c, T.StringType()) for c in named])
    if infer_schema:
        df = reader.option("inferSchema", True).csv(path)
        # No rows are no evidence for any type: the fixed all-text schema.
        df = df.toDF(*named) if df.columns else reader.schema(text).csv(path)
    else:
        df = reader.schema(text).csv(path)
    return df.repartition(partitions) if partitions else df


def rename_columns(df: DataFrame, names: dict[str, str] = POSITIONAL_NAMES) -> DataFrame:
    """Positional ``_cN`` -> our names; fails loudly on a missing column
    (``withColumnRenamed`` would skip it silently)."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.withColumnsRenamed(names)


def write_catalog_text(df: DataFrame, path: str, sep: str = "\t", compression: str | None = None) -> str:
    """Write headerless delimited text.  Leading/trailing spaces are kept:
    Spark's CSV writer trims them by default, which would change the data."""
    writer = (
        df.write.mode("overwrite")
        .option("sep", sep)
        .option("header", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> str:
    """Parquet sink.  With ``partition_by`` and dynamic partition overwrite only
    the partitions present in ``df`` are replaced."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
    return path
