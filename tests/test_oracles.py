"""Every registered query at the smallest scale: against its SQL where there is one, else that it runs."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"compare_models", "market_comparison", "compare_weighting", "disclosure_model", "confidence_band",
        "partial_dependence", "entity_report", "user_report_flags"}  # set TEST_SLOW=1 to run them


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", sorted(entry_module.queries()))
def test_query(spark, con, key):
    if key in SLOW and not os.environ.get("TEST_SLOW"):
        pytest.skip("slow")
    ok, message, _ = compare(spark, con, key, entry_module.queries()[key], entry_module.oracle_sql().get(key), SF_DIR)
    assert ok, message


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["author", "engagement_score_raw", "engagement_rating"]
