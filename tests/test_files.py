"""File sources and sinks (FIXTURES section 6)."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import profile as P
from marquee.sources import derived, files
from marquee.sources.schema import POSITIONAL_NAMES


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_text_round_trip_keeps_padding(spark, sf001, compression):
    raw = derived.raw_catalog(spark, sf001)
    path = files.write_catalog_text(raw, files.scratch_path(spark, "rt"), compression=compression)
    suffix = ".csv.gz" if compression else ".csv"
    back = files.read_catalog_text(spark, f"{path}/part-*{suffix}", multiline=True)
    assert back.count() == raw.count()
    assert back.exceptAll(raw).count() == 0
    # padded dates survive the writer (it trims by default)
    assert back.filter(F.col("added_on").startswith(" ")).count() > 0


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_text_round_trip_is_lossless(spark, compression):
    values = ["two\nlines", 'say "hi"', "a\tb", "back\\slash", "", None, " padded ", "\n", "'"]
    rows = [(str(i), *[v] * 11) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, files.RAW_SCHEMA)
    path = files.write_catalog_text(df, files.scratch_path(spark, "lossless"), compression=compression)
    back = files.read_catalog_text(spark, path, multiline=True)
    assert sorted(back.collect(), key=lambda r: r[0]) == sorted(df.collect(), key=lambda r: r[0])


def test_partitions_are_the_callers_choice(spark, sf0001):
    path = files.write_catalog_text(derived.raw_catalog(spark, sf0001), files.scratch_path(spark, "parts"))
    assert files.read_catalog_text(spark, path, multiline=True, partitions=5).rdd.getNumPartitions() == 5


class _Session:
    """A session whose cluster names no shared folder."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda _: None})()

    def get(self, key, default=None):
        return default


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_must_name_the_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        files.shared_dir(_Session(master))


def test_clear_scratch_removes_what_was_handed_out(spark, sf0001):
    import os

    path = files.write_parquet(derived.raw_catalog(spark, sf0001), files.scratch_path(spark, "gone"))
    remembered = list(files._SCRATCH)
    files._SCRATCH[:] = [path]
    try:
        assert os.path.isdir(path) and files.clear_scratch(spark) == 1
        assert not os.path.exists(path) and files._SCRATCH == []
    finally:
        files._SCRATCH[:] = [p for p in remembered if p != path]


def test_inferred_types_of_clean_data(spark, sf001):
    from marquee.plans.catalog import QUERIES

    types = {r.column_name: r.data_type for r in QUERIES["infer_schema"](spark, sf001).collect()}
    assert types["title_id"] == types["duration_min"] == types["release_year"] == "int"
    assert types["added_on"] == "date" and types["synopsis"] == "string"


def test_inferred_schema_is_text_on_dirty_data(spark, sf0001):
    raw = derived.raw_catalog(spark, sf0001)
    path = files.write_catalog_text(raw, files.scratch_path(spark, "infer"))
    report = P.schema_report(files.read_catalog_text(spark, path, infer_schema=True, multiline=True)).collect()
    assert [r.column_name for r in report] == list(POSITIONAL_NAMES.values())
    assert {r.data_type for r in report} == {"string"}


def test_rename_fails_loudly_on_missing_column(spark):
    df = spark.createDataFrame([("a",)], "_c0 string")
    with pytest.raises(ValueError):
        files.rename_columns(df)


def test_parquet_dynamic_overwrite(spark, sf0001):
    raw = derived.raw_catalog(spark, sf0001).select("title_id", "kind")
    path = files.scratch_path(spark, "dyn")
    files.write_parquet(raw, path, partition_by=["kind"])
    files.write_parquet(raw.filter("kind = 'Movie'").limit(5), path, partition_by=["kind"])
    back = spark.read.parquet(path)
    assert back.filter("kind = 'Movie'").count() == 5
    assert back.filter("kind = 'TV Show'").count() == raw.filter("kind = 'TV Show'").count()


def test_shared_dir_comes_from_the_session(spark):
    assert files.shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None)
                                       or spark.sparkContext.getCheckpointDir())
    assert files.scratch_path(spark, "x").startswith(files.shared_dir(spark))


def test_a_scope_deletes_what_it_does_not_keep(spark):
    import os

    made = {}

    def make(name):
        made[name] = files.write_parquet(spark.range(3), files.scratch_path(spark, name))

    make("outside")
    with pytest.raises(ZeroDivisionError), files.scratch_scope(spark, "kept"):
        make("kept")
        make("gone")
        with files.scratch_scope(spark, "inner", "kept-inner"):
            for name in ("inner", "kept-inner", "inner-gone"):
                make(name)
        assert [n for n, p in made.items() if not os.path.isdir(p)] == ["inner-gone"]
        1 / 0
    there = {n for n, p in made.items() if os.path.isdir(p)}
    assert there == {"outside", "kept"} == {n for n, p in made.items() if p in files._SCRATCH}
    assert spark.read.parquet(made["kept"]).count() == 3
