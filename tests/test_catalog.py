"""Registered queries: contract, and a cross-section compared with DuckDB on the smallest tables."""

import os
import re

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CROSS_SECTION = (
    "interval_composition", "timeline_bins", "rolling_median_4", "interp_limit3", "close_short_gaps", "local_peaks", "attempt_count",
    "event_linkage_first", "pooled_vs_mean", "eight_stats", "forward_candidates", "window_features", "hdr_summary", "silhouette_exact",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 75
    own = {name for name in queries if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(oracles) == {"pca_variance", "kmeans_sweep", "rf_cv"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CROSS_SECTION)
def test_matches_oracle(spark, name):
    assert compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) == []
