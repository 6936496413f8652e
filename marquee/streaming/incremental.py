"""Incremental cleaning of catalogue files as they land (Structured Streaming).

The batch chain reads every file each run.  Here new tab-separated files are
picked up by a file stream, and the only stateful step, one row per title id,
is a streaming aggregation whose state holds the smallest row seen so far for
each id.  Every trigger emits the ids whose surviving row changed (update
mode); ``foreachBatch`` runs the remaining, stateless stages on those rows and
appends them, tagged with the epoch, to a change table.  Readers take the newest
version of every id (``read_clean``), which equals ``clean_catalog`` over all
files seen so far.

Reading every epoch ever written would cost more with each: ``compact`` folds epochs into a base of the
rows that are valid now, and ``read_clean`` reads the newest base and only the epochs after it, so its
cost follows the live ids and the latest changes.  ``expire`` removes what no reader needs any more.

A trigger brings few rows, the state holds all ids: the state lives in RocksDB on the executors' disks, so that
their memory does not grow with it, and a trigger commits the changed rows only.  It is dealt to no more
partitions than tasks run at once, since every one of them costs files at every trigger.  A checkpoint keeps the store
and the number of partitions that it began with.

Failure behaviour: the aggregation state and the source offsets live in the
checkpoint location; a replayed epoch rewrites its own ``epoch=N`` folder with
identical rows, so the change table stays exact.  A base counts once Spark has committed it
(its ``_SUCCESS`` file); a compaction that was killed leaves a folder that readers pass over and the next run
writes anew.  An epoch replayed after it was folded in is passed over too.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marquee.operators import clean as C
from marquee.sources.files import UNQUOTED_EMPTY, committed_folders
from marquee.sources.schema import CLEAN_COLUMNS, CLEAN_SCHEMA, RAW_SCHEMA


def catalog_stream(
    spark: SparkSession,
    source_dir: str,
    sep: str = "\t",
    max_files_per_trigger: int | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Streaming DataFrame of raw catalogue rows from files in ``source_dir``,
    read as ``files.read_catalog_text`` reads them."""
    reader = spark.readStream.schema(RAW_SCHEMA).option("sep", sep).option("header", False)
    reader = reader.option("multiLine", multiline).option("emptyValue", "").option("nullValue", UNQUOTED_EMPTY)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(source_dir)


def _later_stages(rows: DataFrame) -> DataFrame:
    """Stateless stages after de-duplication in one pass.  Rows that fail a
    stage stay as tombstones (``valid`` false), so a row that turns invalid
    replaces its earlier, valid version."""
    return C.annotate_validity(rows).select(*CLEAN_COLUMNS, "valid")


def _writer(output_path: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        # The folder names the epoch.  As a column of the rows it would be a constant in the generated code, which
        # every trigger would then compile, and begin to run, anew.
        _later_stages(batch).write.mode("overwrite").parquet(os.path.join(output_path, f"epoch={epoch_id}"))

    return write


_STORE = "spark.sql.streaming.stateStore"
STATE_CONF = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",  # would look every row up once more
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def _state_conf(spark: SparkSession) -> Iterator[None]:
    """The settings of the state, for a stream that starts meanwhile (it copies them); what the session sets of the
    store stays as it is, and all is put back afterwards."""
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    wanted = {k: v for k, v in STATE_CONF.items() if spark.conf.get(k, None) is None}
    wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def start_clean_stream(
    stream: DataFrame,
    output_path: str,
    checkpoint_location: str,
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start the incremental cleaning query; returns the running query."""
    deduped = C.clean_identity(stream)
    writer = (
        deduped.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint_location)
        .foreachBatch(_writer(output_path))
    )
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    with _state_conf(stream.sparkSession):
        return writer.start()


BASE = "_base"  # Spark's readers pass over folders that begin with an underscore
_CHANGE_FIELDS = [*CLEAN_SCHEMA.fields, T.StructField("valid", T.BooleanType())]


def _base(spark: SparkSession, output_path: str) -> tuple[int, DataFrame | None]:
    """(last epoch folded in, valid rows then) of the newest committed base; (-1, None) before the first."""
    bases = committed_folders(spark, os.path.join(output_path, BASE), "through")
    if not bases:
        return -1, None
    return bases[-1], spark.read.schema(CLEAN_SCHEMA).parquet(os.path.join(output_path, BASE, f"through={bases[-1]}"))


def _newest(spark: SparkSession, output_path: str, epochs: list[int]) -> DataFrame:
    """The newest version of every id that changed in ``epochs``, tombstones included.

    ``max_by`` per id is an aggregate (partial + final), so an id rewritten in
    many epochs costs one buffer row per map task.
    """
    schema = T.StructType([*_CHANGE_FIELDS, T.StructField("epoch", T.LongType())])
    paths = [os.path.join(output_path, f"epoch={n}") for n in epochs]
    if paths:
        changes = spark.read.schema(schema).option("basePath", output_path).parquet(*paths)
    else:
        changes = spark.createDataFrame([], schema)
    row = F.struct(*[f.name for f in _CHANGE_FIELDS if f.name != "title_id"])
    return changes.groupBy("title_id").agg(F.max_by(row, "epoch").alias("_row"))


def _current(base: DataFrame | None, newest: DataFrame) -> DataFrame:
    """The base without the ids that changed since, and their newest rows where these are valid.  The base is
    joined by the changed ids only and never aggregated."""
    valid = newest.filter(F.col("_row.valid")).select(
        *[F.col("title_id" if c == "title_id" else f"_row.{c}").alias(c) for c in CLEAN_COLUMNS]
    )
    if base is None:
        return valid
    kept = base.select(*CLEAN_COLUMNS).join(newest.select("title_id"), "title_id", "left_anti")
    return kept.select(*CLEAN_COLUMNS).unionByName(valid)


def read_clean(spark: SparkSession, output_path: str) -> DataFrame:
    """Current clean catalogue: newest version of every id, valid ones only.  Opens the newest base and the
    epochs after it; no epoch yet gives no rows."""
    through, base = _base(spark, output_path)
    later = [n for n in committed_folders(spark, output_path, "epoch") if n > through]
    return _current(base, _newest(spark, output_path, later))


def compact(spark: SparkSession, output_path: str, through: int | None = None) -> int:
    """Fold the epochs up to ``through`` into a new base; returns the last epoch that the newest base holds (-1: none).

    By default all but the newest epoch, which alone may be written again after a failure.  Running it
    again, also after it was killed, gives the same base; an id whose newest version is invalid is not in it.
    """
    done, base = _base(spark, output_path)
    epochs = [n for n in committed_folders(spark, output_path, "epoch") if n > done]
    epochs = [n for n in epochs if n <= through] if through is not None else epochs[:-1]
    if not epochs:
        return done
    target = os.path.join(output_path, BASE, f"through={epochs[-1]}")
    rows = _current(base, _newest(spark, output_path, epochs))
    # Clustered by id, so that reads of a range of ids skip row groups.
    rows.repartitionByRange("title_id").sortWithinPartitions("title_id").write.mode("overwrite").parquet(target)
    return epochs[-1]


def expire(spark: SparkSession, output_path: str, keep_bases: int = 2) -> int:
    """Delete the bases but for the newest ``keep_bases``, and the epochs that the oldest of those holds; returns
    how many folders went.  Readers that began with a kept base go on undisturbed; repeatable."""
    if keep_bases < 1:
        raise ValueError("a base must stay")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    bases = committed_folders(spark, os.path.join(output_path, BASE), "through")
    if not bases:
        return 0
    oldest = bases[-keep_bases:][0]
    old = [os.path.join(output_path, BASE, f"through={n}") for n in bases if n < oldest]
    old += [os.path.join(output_path, f"epoch={n}") for n in committed_folders(spark, output_path, "epoch") if n <= oldest]
    for name in old:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(old)
