"""Views over tables of few splits are computed by all cores."""

from __future__ import annotations

import pytest

from letterspark.plans.fixtures import view


@pytest.mark.parametrize("name", ["fx_domains", "fx_bodies", "fx_ledger"])
def test_views_of_small_files_use_all_cores(spark, name):
    """heavy projections over a view of one small file ran in a single task."""
    assert view(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
