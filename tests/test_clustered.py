"""Clustered export: rows equal, few files opened, only touched partitions replaced, kills harmless."""

import os

import pytest
from pyspark.sql import functions as F

from marquee.sources import clustered as K
from marquee.sources import files


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def rows(spark):
    """20,000 rows; a third have one partition and key; some have no partition or no key."""
    i = F.col("id")
    part = F.when(i % 3 == 0, "hot").when(i % 50 == 1, None).otherwise(F.concat(F.lit("p "), i % 4))
    key = F.when(i % 3 == 0, 500).when(i % 40 == 2, None).otherwise((i * 7919) % 1000).cast("int")
    return files.materialize(spark.range(20_000).select("id", part.alias("part"), key.alias("key")), "rows")


def test_round_trip_and_point_filter(spark, rows):
    path = files.scratch_path(spark, "clustered")
    assert K.write_clustered(rows, path, "part", "key", rows_per_file=500) == 0
    assert same(K.read_clustered(spark, path, "key"), rows)
    held = K.manifest(spark, path).filter("file IS NOT NULL")
    assert held.agg(F.sum("rows"), F.max("rows")).first()[:] == (20_000, 500)
    total = held.count()
    got = K.read_clustered(spark, path, "key", 123, 123)
    assert same(got, rows.filter("key = 123"))
    assert 0 < len(got.inputFiles()) <= 2 * rows.select("part").distinct().count() < total / 3
    assert same(K.read_clustered(spark, path, "key", low=990), rows.filter("key >= 990"))
    assert same(K.read_clustered(spark, path, "key", high=10), rows.filter("key <= 10"))
    assert K.read_clustered(spark, path, "key", 5000, 6000).collect() == []


def test_hot_key_is_dealt_out(spark, rows):
    path = files.scratch_path(spark, "clustered")
    K.write_clustered(rows, path, "part", "key", partitions=12)
    hot = K.manifest(spark, path).filter("partition = '=hot'")
    assert hot.count() >= 3 and hot.agg(F.max("rows")).first()[0] < 20_000 / 6


def test_only_touched_partitions_are_replaced(spark, rows):
    path = files.scratch_path(spark, "clustered")
    K.write_clustered(rows, path, "part", "key")
    before = {r.file for r in K.manifest(spark, path).filter("partition <> '=p 1' AND partition <> 'null'").collect()}
    new = spark.createDataFrame([(1, "p 1", 7), (2, None, None)], rows.schema)
    assert K.write_clustered(new, path, "part", "key") == 1
    want = rows.filter("part IS NOT NULL AND part <> 'p 1'").unionByName(new)
    assert same(K.read_clustered(spark, path, "key"), want)
    assert before <= {r.file for r in K.manifest(spark, path).collect()}
    # Nothing touched; a killed export; other columns.
    K.write_clustered(new.limit(0), path, "part", "key")
    broken = os.path.join(path, "manifest", "version=3")
    spark.range(1).write.parquet(broken)
    os.remove(os.path.join(broken, "_SUCCESS"))
    assert same(K.read_clustered(spark, path, "key"), want)
    with pytest.raises(ValueError):
        K.write_clustered(new.drop("id"), path, "part", "key")
    assert K.write_clustered(new, path, "part", "key") == 3
    assert same(K.read_clustered(spark, path, "key"), want)


def test_empty_table(spark, rows):
    path = files.scratch_path(spark, "clustered")
    with pytest.raises(ValueError):
        K.read_clustered(spark, path, "key")
    K.write_clustered(rows.limit(0), path, "part", "key")
    got = K.read_clustered(spark, path, "key", 1)
    assert got.columns == rows.columns and got.collect() == []
