"""Plan shape: no Python in default plans, pruned scans, top-k, shuffles."""

import pytest

from marquee.plans.catalog import QUERIES

# Keys whose callables write files before returning (checked elsewhere).
SIDE_EFFECT = {"clean_incremental", "export_clean_clustered", "scan_tsv", "scan_tsv_gz", "infer_schema", "parquet_roundtrip", "export_clean",
               "export_clean_counted"}
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def required(text: str) -> int:
    """Hash shuffles that operators need, without the one that deals a derived table out."""
    return sum("Exchange hashpartitioning" in x and "ENSURE_REQUIREMENTS" in x for x in text.splitlines())


@pytest.mark.parametrize("key", sorted(set(QUERIES) - SIDE_EFFECT))
def test_no_python_in_default_plans(spark, sf001, key):
    text = plan_text(QUERIES[key](spark, sf001))
    if key == "udf_count_items":
        assert any(n in text for n in PYTHON_NODES)
    else:
        assert not any(n in text for n in PYTHON_NODES), key


def test_orders_scan_is_pruned(spark, sf001):
    text = plan_text(QUERIES["clean_catalog"](spark, sf001))
    assert "o_orderstatus" not in text and "o_totalprice" not in text
    assert text.count("FileScan parquet") == 1


def test_top1_is_take_ordered(spark, sf001):
    for key in ("top1", "top_performer", "topk_desc", "preview"):
        assert "TakeOrderedAndProject" in plan_text(QUERIES[key](spark, sf001)), key


def test_compare_country_has_no_join(spark, sf001):
    text = plan_text(QUERIES["compare_country_all"](spark, sf001))
    assert "Join" not in text
    # one shuffle for the de-duplication, one for the country aggregate (and the caller's: the derived table)
    assert required(text) == 2


def test_performer_filter_uses_scalar_subquery(spark, sf001):
    text = plan_text(QUERIES["performer_titles"](spark, sf001))
    assert "Subquery" in text and "NestedLoop" not in text and "Cartesian" not in text


AGGREGATES = ["avg_by_combination", "avg_by_country", "compare_country_all", "music_performers",
              "agg_group_count", "dedupe_by_key", "release_span", "coproduction_counts",
              "null_profile", "clean_funnel"]


@pytest.mark.parametrize("key", AGGREGATES)
def test_every_aggregate_shuffle_is_pre_aggregated(spark, sf001, key):
    """Hot keys cost one buffer row per map task: every hash shuffle feeding an
    aggregate sits on top of a partial aggregate."""
    plan = QUERIES[key](spark, sf001)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            if "ENSURE_REQUIREMENTS" in line and "SortMergeJoin" not in text:
                assert "partial_" in below, (key, line, below)


def test_filters_reach_a_stored_catalogue_scan(spark, sf001):
    """With the catalogue stored as Parquet (the raw text converted once), the
    kind and genre tests are pushed into the scan."""
    from marquee.operators import clean as C
    from marquee.sources import derived, files

    stored = files.materialize(derived.raw_catalog(spark, sf001), "raw_pushdown")
    text = plan_text(C.clean_catalog(stored))
    assert "PushedFilters: [IsNotNull(title_id), In(kind, [Movie,TV Show])" in text
    assert "IsNotNull(genres)" not in text  # genre test stays after the de-duplication (Q6)
    only_genres = plan_text(stored.filter("genres IS NOT NULL").select("title_id"))
    assert "IsNotNull(genres)" in only_genres and "ReadSchema: struct<title_id:string,genres:string>" in only_genres


@pytest.mark.parametrize("key", sorted(set(QUERIES) - SIDE_EFFECT))
def test_no_round_robin(spark, sf001, key):
    assert "RoundRobin" not in plan_text(QUERIES[key](spark, sf001))


def test_funnel_scans_once(spark, sf001):
    for key in ("clean_funnel", "clean_funnel_keep"):
        text = plan_text(QUERIES[key](spark, sf001))
        assert text.count("FileScan") == 1 and required(text) == 1


def test_hot_title_is_split_without_adaptive_execution(spark):
    """Half of the rows on one title, another tenth without: no task has twice the median's rows."""
    from pyspark.sql import functions as F

    from marquee.operators import explore as E

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        title = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 != 1, F.concat(F.lit("t"), F.col("id") % 5000))
        titles = spark.range(200_000).select(F.col("id").alias("title_id"), title.alias("title"))
        dates = titles.groupBy("title").agg(F.min(F.date_from_unix_date(F.col("title_id").cast("int"))).alias("release_date"))
        joined = E.attach_dates(titles, dates)
        assert joined.columns == titles.join(dates, "title", "left").columns
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 200_000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
        plain = titles.join(dates, "title", "left")
        assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()
        empty = titles.filter("title_id < 0")
        assert E.attach_dates(empty, dates).isEmpty()
        assert E.attach_dates(titles, dates.filter("title = ''")).filter("release_date IS NULL").count() == 200_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_derived_columns_are_evaluated_once(spark, sf001):
    """One date parse, and one extraction of minutes and of seasons, in the executed plan."""
    text = plan_text(QUERIES["clean_catalog"](spark, sf001))
    assert text.count("gettimestamp") == 1
    for unit in ("min", "Season"):
        lines = [x for x in text.splitlines() if "regexp_extract(duration" in x and unit in x]
        assert len(lines) == 1, (unit, len(lines))
