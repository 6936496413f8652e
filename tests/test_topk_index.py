"""Bounded top-k against counting everything; the n-gram index against a scan."""

import re

import pytest
from pyspark.sql import functions as F

from marquee.operators import explore as E
from marquee.operators import substring_index as S
from marquee.operators import topk
from marquee.plans.catalog import clean
from marquee.sources import files


def plain_top(items, n):
    return items.groupBy("x").agg(F.count("x").alias("appearances")).filter("x IS NOT NULL").orderBy(
        F.desc("appearances"), "x").limit(n).collect()


@pytest.fixture(scope="module")
def names(spark):
    """300,000 rows: mostly distinct names, one with a third of the rows, 40 common ones with ties, NULLs."""
    i = F.col("id")
    x = (F.when(i % 3 == 0, "hot").when(i % 97 == 1, None).when(i % 30 == 1, F.concat(F.lit("c"), F.floor(i / 30) % 40))
         .otherwise(F.concat(F.lit("rare "), i)))
    return files.materialize(spark.range(300_000).select(x.alias("x")), "names")


@pytest.mark.parametrize("n", [1, 5, 20])
def test_bounded_top_equals_counting_all(names, n):
    assert topk.top_items_bounded(names, n, "x").collect() == plain_top(names, n)


def test_few_rows_survive_among_distinct_names(names):
    kept = topk.surviving_items(names, 10, "x")
    assert kept.select("x").distinct().count() < 200
    assert names.select("x").distinct().count() > 150_000


def test_flat_counts_few_items_and_empty(spark, names):
    flat = spark.range(3000).select(F.col("id").cast("string").alias("x"))
    assert topk.top_items_bounded(flat, 7, "x").collect() == plain_top(flat, 7)
    few = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "x string")
    assert [tuple(r) for r in topk.top_items_bounded(few, 5, "x").collect()] == [("a", 2), ("", 1)]
    assert topk.top_items_bounded(names.filter("x = 'none'"), 5, "x").collect() == []
    with pytest.raises(ValueError):
        topk.top_items_bounded(names, 0, "x")


def test_index_finds_what_a_scan_finds_for_every_performer(spark, sf001):
    titles = files.materialize(clean(spark, sf001), "titles")
    path = S.build(titles, "performers", files.scratch_path(spark, "index"))
    every = [r.performer for r in E.frequent_items(titles).collect()]
    asked = every + ["", "A", "or", "1, A", "nobody", "Actor 1", "Actor 1"]
    got = S.search(spark, path, "performers", asked)
    assert got.columns == ["name", *titles.columns]
    counts = {r["name"]: (r["n"], r["s"]) for r in got.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("title_id").alias("s")).collect()}
    texts = [(r.performers, r.title_id) for r in titles.select("performers", "title_id").collect() if r.performers is not None]
    for name in set(asked):
        hits = [i for t, i in texts if name in t]
        assert counts.get(name, (0, None)) == (len(hits), sum(hits) if hits else None), name
    one = S.search(spark, path, "performers", ["Actor 1"]).drop("name")
    scan = E.performer_titles(titles, "Actor 1")
    assert one.exceptAll(scan).isEmpty() and scan.exceptAll(one).isEmpty()


def test_index_reads_only_the_lists_needed(spark):
    rows = spark.range(5000).select(F.col("id"), F.concat(F.lit("n"), F.hex("id"), F.lit(" é漢😀")).alias("t"))
    path = S.build(rows, "t", files.scratch_path(spark, "index"))
    lists = S.lists_of(spark, path, ["nAB"])
    assert {r["_gram"] for r in lists.select("_gram").collect()} == {"nAB"}
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_shelf", plan) and re.search(r"PushedFilters: \[[^\]]*_gram", plan)
    assert len(lists.inputFiles()) > 0
    got = S.search(spark, path, "t", ["漢😀", "nABC "])
    assert {(r["name"], r["n"]) for r in got.groupBy("name").agg(F.count("id").alias("n")).collect()} == {("漢😀", 5000), ("nABC ", 1)}


def test_index_of_nulls_repeats_full_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(S, "FILL", 1 << 20)  # one block for all: its rows go on in further bitmaps
    rows = spark.range(70_000).select(F.when(F.col("id") % 7 > 0, F.lit("same text")).alias("t"))
    path = S.build(rows, "t", files.scratch_path(spark, "index"))
    assert S.search(spark, path, "t", ["me te"]).count() == 60_000
    assert S.search(spark, path, "t", [""]).count() == 60_000
    assert S.search(spark, path, "t", []).count() == 0
    path = S.build(rows.limit(0), "t", files.scratch_path(spark, "index"))
    assert S.search(spark, path, "t", ["me", ""]).collect() == []
