"""Delimited text read in pieces: equal to the reader that takes a file as one task."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marquee.sources import delimited as D
from marquee.sources import derived, files

NAMES = [f"c{i}" for i in range(4)]
VALUES = [
    "plain", "two\nlines", "\n\n\n", 'say "hi"', '"', '""', '"quoted"', "a\tb", "back\\slash", "ends in \\", '\\"', "", None,
    " padded ", 'mix\n"of\tall\\ things"\n', "'", "x" * 3000, "long\n" * 400, "é\U0001f600 \x85",
]


@pytest.fixture
def pieces(spark):
    """Splits of a few hundred bytes, each a partition of its own."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "700")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def whole_files(spark, path, names=NAMES):
    reader = spark.read.option("sep", "\t").option("multiLine", True).option("emptyValue", "").option("nullValue", "\x01")
    return reader.schema(", ".join(f"{c} string" for c in names)).csv(path)


def written(text):
    path = os.path.join(tempfile.mkdtemp(prefix="marquee-delimited-"), "data.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_one_file_in_many_pieces(pieces):
    rows = [tuple(VALUES[(i * k + k) % len(VALUES)] for k in (1, 3, 5, 7)) for i in range(4 * len(VALUES))]
    rows = [(f"{i}", *r[1:]) for i, r in enumerate(rows)]
    df = pieces.createDataFrame(rows, ", ".join(f"{c} string" for c in NAMES))
    path = files.write_catalog_text(df.coalesce(1), files.scratch_path(pieces, "pieces"))
    got = D.read_delimited(pieces, path, NAMES)
    assert D.read_records(pieces, path).rdd.getNumPartitions() > 20
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    same(got, whole_files(pieces, path))


@pytest.mark.parametrize("text", [
    '1\tfive " inch\tx\n2\t"a\nb"\ty\n3\tsix " inch\tz\n' * 60,  # quotes inside unquoted values
    "1\ta\n\n\n2\tb\n" * 100,  # empty lines
    "1\ta\tb\tc\n2\tb" + "\n3\t\t\t\td" * 80,  # missing and surplus columns, no last line break
    '1\t"' + "line\n" * 900 + '"\tx\n2\tb\n',  # one value over many pieces
    "", "\n", "1",
])
def test_texts(pieces, text):
    path = written(text)
    same(D.read_delimited(pieces, path, NAMES), whole_files(pieces, path))


def test_a_value_left_open_ends_with_its_file(pieces):
    first, second = written('1\t"open\n' + "more\n" * 300), written("2\tb\n" * 300)
    got = pieces.createDataFrame([], "record string")
    for path in (first, second):
        got = got.union(D.read_records(pieces, path))
    both = D.read_records(pieces, os.path.dirname(second))
    assert got.filter("record LIKE '1%'").count() == 1 and got.filter("record = '2\tb'").count() == 300
    assert both.count() == 300


def test_quotes_need_not_be_in_step_with_pieces(spark):
    """Every way to cut: pieces of 64 to 90 bytes over the same text."""
    text = "".join(f'{i}\t"a\n{i} \\" b"\tc "d" e\t"{"z" * (i % 9)}"\n' for i in range(60))
    path = written(text)
    want = sorted(map(repr, whole_files(spark, path).collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (64, 77, 90):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert sorted(map(repr, D.read_delimited(spark, path, NAMES).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_only_fragments_are_shuffled(pieces):
    raw = derived.raw_catalog(pieces, "/root/testdata/sf0.001").coalesce(1)
    path = files.write_catalog_text(raw.limit(400), files.scratch_path(pieces, "plan"))
    plain = D.read_delimited(pieces, written("1\ta\n" * 500), NAMES)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    got = D.read_delimited(pieces, path, files.RAW_SCHEMA.fieldNames())
    assert got.exceptAll(raw).count() == 0 and got.count() == 400


def test_gzip_and_partitions(spark):
    df = spark.createDataFrame([(str(i), "a\nb", None, "") for i in range(50)], ", ".join(f"{c} string" for c in NAMES))
    path = files.write_catalog_text(df, files.scratch_path(spark, "gz"), compression="gzip")
    got = D.read_delimited(spark, path, NAMES, partitions=3)
    assert got.rdd.getNumPartitions() == 3
    same(got, df.withColumn("c3", F.lit("")))
