"""Properties and golden numbers of the cleaning chain and explorations."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import clean as C
from marquee.operators import explore as E
from marquee.plans.catalog import QUERIES
from marquee.sources import derived

from conftest import sf_dir

# Golden funnel (FIXTURES section 8): rows left after each cumulative step.
GOLDEN = {
    "0.001": [1500, 1468, 1415, 1381, None, 1063, 1034, 1017, 1000, 923, 886],
    "0.01": [15000, 14680, 14158, 13832, None, 10801, 10556, 10427, 10305, 9558, 9253],
    "0.1": [150000, 146808, 141596, 138340, None, 107911, 105416, 104105, 102874, 95120, 91842],
}
MUSIC = {"0.001": 117, "0.01": 1151, "0.1": 11452}
COPRODUCTION = {"0.001": (677, 209), "0.01": (6971, 2282), "0.1": (68760, 23082)}
TOP = {"0.001": ("Actor 29", 10), "0.01": ("Actor 31", 65), "0.1": ("Actor 15", 578)}


@pytest.mark.parametrize("sf", sorted(GOLDEN))
def test_golden_funnel(spark, sf):
    d = sf_dir(sf)
    rows = sorted((r.step_no, r.rows) for r in QUERIES["clean_funnel"](spark, d).collect())
    assert [n for _, n in rows][:4] == GOLDEN[sf][:4]
    assert [n for _, n in rows][5:] == GOLDEN[sf][5:]
    counts = [n for _, n in rows]
    assert counts == sorted(counts, reverse=True), "the funnel never grows"
    assert QUERIES["clean_catalog"](spark, d).count() == GOLDEN[sf][-1]
    assert E.music_titles(QUERIES["clean_catalog"](spark, d)).count() == MUSIC[sf]
    co = QUERIES["coproduction_counts"](spark, d).collect()[0]
    assert (co.solo_titles, co.coproduced_titles) == COPRODUCTION[sf]
    top = QUERIES["top_performer"](spark, d).collect()[0]
    assert (top.performer, top.appearances) == TOP[sf]


def test_composites_sf001(spark, sf001):
    got = {r.country: (r.combination_mean, r.participation_mean)
           for r in QUERIES["compare_country_all"](spark, sf001).collect()}
    assert got == {"France": (122.99, 122.71), "India": (117.17, 117.5), "Spain": (120.15, 120.15)}
    combos = QUERIES["avg_by_combination"](spark, sf001)
    assert [r.countries for r in combos.filter(F.col("mean_minutes").isNull()).collect()] == [
        "United States, Mexico"]
    assert QUERIES["performer_titles"](spark, sf001).count() == 64
    span = QUERIES["release_span"](spark, sf001).collect()[0]
    assert span.days == 2341 and abs(span.weeks - 334.42857142857144) < 1e-9
    attached = QUERIES["attach_release_date"](spark, sf001)
    assert attached.count() == 64 and attached.filter(F.col("release_date").isNotNull()).count() == 53


def test_ids_unique_and_stages_idempotent(spark, sf001):
    clean = QUERIES["clean_catalog"](spark, sf001)
    assert clean.count() == clean.select("title_id").distinct().count()
    ident = C.clean_identity(derived.raw_catalog(spark, sf001))
    once = C.clean_title(C.clean_text(ident))
    twice = C.clean_title(C.clean_text(once))
    assert once.count() == twice.count()
    assert once.exceptAll(twice).count() == 0


def test_explode_count_equals_item_count(spark, sf001):
    clean = QUERIES["clean_catalog"](spark, sf001)
    exploded = E.explode_items(clean, "countries", "country").count()
    total = clean.agg(F.sum(F.size(F.split("countries", ", ")))).collect()[0][0]
    assert exploded == total


def test_combination_equals_participation_for_single_country_titles(spark, sf001):
    clean = QUERIES["clean_catalog"](spark, sf001).filter(~F.col("countries").contains(","))
    a = {r.countries: r.mean_minutes for r in E.avg_by(clean, "countries").collect()}
    b = {r.country: r.mean_minutes for r in E.avg_by_item(clean, "countries", "country").collect()}
    assert a == b


def test_compare_country_single_pass_equals_join(spark, sf001):
    clean = QUERIES["clean_catalog"](spark, sf001)
    a = E.compare_country(clean)
    b = E.compare_country_join(clean)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_result_unchanged_under_repartition(spark, sf001):
    raw = derived.raw_catalog(spark, sf001)
    a = C.clean_catalog(raw)
    b = C.clean_catalog(raw.repartition(13, "title").sortWithinPartitions("synopsis"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_dedupe_survives_a_hot_key(spark):
    """A third of all rows share one id: partial aggregation keeps it to one
    buffer row per map task, and the survivor is still the smallest row."""
    rows = [(1, f"t{i:05d}") for i in range(3000)] + [(i, "x") for i in range(2, 6002)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(8)
    out = C.dedupe_by_key(df, "k")
    assert out.count() == 6001
    assert out.filter("k = 1").collect()[0].v == "t00000"


def test_report_equals_queries(spark, sf001):
    from marquee.plans.report import catalog_report

    report = catalog_report(spark, sf001)
    for key, df in report.items():
        want = QUERIES[key](spark, sf001)
        assert df.exceptAll(want).count() == 0 and want.exceptAll(df).count() == 0, key
    # explorations read the materialized table, not the orders scan again
    plan = report["compare_country_all"]._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and "catalog_flagged-" in plan
    assert "ReadSchema: struct<countries:string,duration_min:int,valid:boolean>" in plan


def test_funnels_end_where_their_chains_end(spark, sf001):
    for funnel, chain in (("clean_funnel", "clean_catalog"), ("clean_funnel_keep", "clean_catalog_keep")):
        left = min(r.rows for r in QUERIES[funnel](spark, sf001).collect())
        assert left == QUERIES[chain](spark, sf001).count()
    assert QUERIES["clean_catalog_keep"](spark, sf001).count() == 11177
    assert QUERIES["clean_catalog_as_run"](spark, sf001).count() == 9340


@pytest.mark.parametrize("options", [
    {"kinds": ("Movie",)}, {"id_length": 7}, {"min_year": 2000, "max_year": 2010}, {"ratings": ("PG-13",)},
    {"fmt": "yyyy-MM-dd"}, {"null_policy": "keep", "text_patterns": (r"^[0-9]+$",)},
])
def test_options_reach_chain_flags_and_funnel_alike(spark, sf001, options):
    raw = derived.raw_catalog(spark, sf001)
    chain = C.clean_catalog(raw, **options)
    rest = {k: v for k, v in options.items() if k not in ("kinds", "id_length")}
    ident = C.clean_identity(raw, **{k: v for k, v in options.items() if k not in rest})
    flagged = C.annotate_validity(ident, **rest).filter("valid").drop("valid").select(*chain.columns)
    assert chain.exceptAll(flagged).isEmpty() and flagged.exceptAll(chain).isEmpty()
    assert min(r.rows for r in C.clean_funnel(raw, **options).collect()) == chain.count()


def test_extra_columns_stay(spark, sf001):
    raw = derived.raw_catalog(spark, sf001).withColumn("source file", F.lit("a.tsv"))
    clean = C.clean_catalog(raw)
    assert "source file" in clean.columns and clean.count() == 9253
    assert min(r.rows for r in C.clean_funnel(raw).collect()) == 9253
