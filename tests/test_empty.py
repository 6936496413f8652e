"""Every query runs on empty input (FIXTURES section 5, last row)."""

import os

import pytest

from marquee.plans.catalog import QUERIES
from marquee.sources import derived, files

# One-row results by construction (global aggregates, schema reports).
ONE_ROW = {"agg_null_counts", "agg_count_if", "agg_max_min", "coproduction_counts",
           "coproduction_counts_music", "release_span"}


@pytest.fixture(scope="module")
def empty_dir(spark, sf0001):
    path = files.scratch_path(spark, "empty_sf")
    orders = derived.load_table(spark, sf0001, "orders")
    orders.limit(0).write.parquet(os.path.join(path, "orders.parquet"))
    for name in ("pages", "documents"):
        derived.load_table(spark, sf0001, name).limit(0).write.parquet(os.path.join(path, f"{name}.parquet"))
    return path


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_on_empty_input(spark, empty_dir, key):
    rows = QUERIES[key](spark, empty_dir).collect()
    if key in ONE_ROW:
        assert len(rows) == 1
    elif key in ("null_profile", "null_profile_clean"):
        assert rows and all(r.nulls == 0 for r in rows)
    elif key in ("schema_report", "row_count", "clean_funnel", "clean_funnel_keep", "infer_schema"):
        assert rows
    else:
        assert rows == [], key
