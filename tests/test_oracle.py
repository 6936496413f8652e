"""Every registered query equals its DuckDB oracle at sf0.01 (values and types)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import oracle_check  # noqa: E402
from marquee.plans.catalog import QUERIES  # noqa: E402

KEYS = sorted(QUERIES)


def test_every_query_is_registered_with_an_oracle():
    assert set(KEYS) <= set(entry.queries())
    assert set(KEYS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf001, key):
    assert oracle_check.check(spark, sf001, [key], verbose=False) == []


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["country", "combination_mean", "participation_mean"]
    assert df.count() > 0
