"""Incremental cleaning equals the batch chain over all files seen."""

import os
import tempfile

from pyspark.sql import functions as F

from marquee.operators import clean as C
from marquee.sources import derived, files
from marquee.streaming import incremental as S


def test_stream_equals_batch(spark, sf0001):
    raw = derived.raw_catalog(spark, sf0001)
    base = tempfile.mkdtemp(prefix="marquee-stream-")
    src = os.path.join(base, "in")
    # two arrivals; the second repeats some ids with other rows
    first = raw.filter(F.col("title").endswith("1") | F.col("title").endswith("3"))
    second = raw.exceptAll(first).unionByName(raw.limit(200))
    out = os.path.join(base, "out")
    ckpt = os.path.join(base, "ckpt")
    for name, part in (("a", first), ("b", second)):
        files.write_catalog_text(part, os.path.join(src, name))
        q = S.start_clean_stream(S.catalog_stream(spark, f"{src}/*/part-*.csv", multiline=True), out, ckpt)
        q.awaitTermination()
    got = S.read_clean(spark, out)
    want = C.clean_catalog(raw.unionByName(raw.limit(200)))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_compaction_survives_kills_and_reads_only_live_rows(spark, sf0001):
    """Five arrivals that rewrite the same ids, with a compaction stopped, repeated and followed by more epochs."""
    raw = files.materialize(derived.raw_catalog(spark, sf0001), "raw")
    base = tempfile.mkdtemp(prefix="marquee-stream-")
    src, out, ckpt = (os.path.join(base, n) for n in ("in", "out", "ckpt"))
    assert S.read_clean(spark, out).isEmpty() and S.compact(spark, out) == -1 and S.expire(spark, out) == 0

    def arrive(n):
        # Versions of all rows: the directors, which de-duplication compares first, fall from arrival to arrival,
        # and some rows turn invalid in the fourth.
        part = raw.withColumn("directors", F.lit(f"Director {9 - n}"))
        if n == 3:
            part = part.withColumn("directors", F.when(F.col("title").endswith("1"), "12345").otherwise("A Director"))
        files.write_catalog_text(part, os.path.join(src, str(n)))
        S.start_clean_stream(S.catalog_stream(spark, f"{src}/*/part-*.csv", multiline=True), out, ckpt).awaitTermination()

    def plain():
        """Newest version of every id over all epochs, read whole."""
        changes = spark.read.parquet(*[kept[n] for n in sorted(kept)]) if kept else None
        newest = changes.groupBy("title_id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "title_id"]), "epoch").alias("r"))
        return newest.filter("r.valid").select("title_id", *[F.col(f"r.{c}").alias(c) for c in S.CLEAN_COLUMNS if c != "title_id"])

    kept = {}

    def keep():
        for n in files.committed_folders(spark, out, "epoch"):
            if n not in kept:
                copy = files.scratch_path(spark, f"epoch-{n}")
                spark.read.parquet(os.path.join(out, f"epoch={n}")).withColumn("epoch", F.lit(n).cast("long")).write.parquet(copy)
                kept[n] = copy

    for n in range(3):
        arrive(n)
    keep()
    assert len(kept) == 3 and same(S.read_clean(spark, out), plain())
    # Killed while it wrote: a folder without the mark of a committed job.
    broken = os.path.join(out, S.BASE, "through=1")
    S.read_clean(spark, out).limit(5).write.parquet(broken)
    os.remove(os.path.join(broken, "_SUCCESS"))
    assert same(S.read_clean(spark, out), plain())
    assert S.compact(spark, out) == 1 and S.compact(spark, out) == 1
    assert same(S.read_clean(spark, out), plain())
    opened = S.read_clean(spark, out).inputFiles()
    assert opened and all("epoch=2" in f or "through=1" in f for f in opened)
    arrive(3)
    keep()
    want = plain().count()
    assert want < spark.read.parquet(kept[0]).filter("valid").count()
    assert S.compact(spark, out, through=3) == 3
    assert spark.read.parquet(os.path.join(out, S.BASE, "through=3")).count() == want  # no tombstones
    assert same(S.read_clean(spark, out), plain())
    # Killed between deletions: the rest goes with the next run.
    assert S.expire(spark, out, keep_bases=1) == 5 and S.expire(spark, out, keep_bases=1) == 0
    assert same(S.read_clean(spark, out), plain())
    # The last epoch, replayed after it was folded in.
    spark.read.parquet(kept[3]).drop("epoch").write.parquet(os.path.join(out, "epoch=3"))
    assert same(S.read_clean(spark, out), plain())
    arrive(4)
    keep()
    assert same(S.read_clean(spark, out), plain())


def test_annotate_validity_matches_chain(spark, sf001):
    ident = C.clean_identity(derived.raw_catalog(spark, sf001))
    flagged = C.annotate_validity(ident).filter("valid").drop("valid")
    chain = C.clean_catalog(derived.raw_catalog(spark, sf001))
    assert flagged.exceptAll(chain).count() == 0 and chain.exceptAll(flagged).count() == 0


def test_state_is_kept_in_few_partitions_off_the_heap(spark, sf0001):
    """State partitions follow the tasks that run at once, not the shuffle partitions; rows carry no constant of their
    epoch, which would make new generated code of every trigger; the session's settings stay."""
    base = tempfile.mkdtemp(prefix="marquee-stream-")
    src, out, ckpt = (os.path.join(base, n) for n in ("in", "out", "ckpt"))
    files.write_catalog_text(derived.raw_catalog(spark, sf0001, 4), src)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        q = S.start_clean_stream(S.catalog_stream(spark, src, max_files_per_trigger=2, multiline=True), out, ckpt)
        q.awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
        assert all(spark.conf.get(key, None) is None for key in S.STATE_CONF)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    state = q.lastProgress["stateOperators"][0]
    assert state["numShufflePartitions"] == spark.sparkContext.defaultParallelism
    assert any(name.startswith("rocksdb") for name in state["customMetrics"])
    assert files.committed_folders(spark, out, "epoch") == [0, 1]
    for n in (0, 1):
        assert "epoch" not in spark.read.parquet(os.path.join(out, f"epoch={n}")).columns
    assert same(S.read_clean(spark, out), C.clean_catalog(derived.raw_catalog(spark, sf0001)))


def test_text_without_a_number_makes_no_failing_cast(spark):
    """The empty text of a pattern that does not match is never cast."""
    df = spark.createDataFrame([("90 min",), ("2 Seasons",), ("",), (None,), ("99999999999 min",)], "t string")
    out = df.select(C.X.extract_int("t", C.X.MINUTES_PATTERN).alias("n"))
    assert [r.n for r in out.collect()] == [90, None, None, None, None]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "try_cast(regexp_extract(" not in plan
