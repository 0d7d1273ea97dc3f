"""Registered queries against their SQL twins. PERFGRID_ALL=1 runs every query."""

from __future__ import annotations

import os

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry

SF = os.environ.get("PERFGRID_SF", "/root/testdata/sf0.001")
QUICK = [
    "ber", "class_error", "median_top", "constant_folds", "stratified_folds", "holdout_split", "nested_split", "greedy_prefix",
    "merge_rows", "filter_configs", "missing_cells", "resolve_pct", "task_grid", "poly_features", "impute_median", "preprocess_all",
    "select_k_best", "cv_gnb", "cv_prepared", "ada_round1", "greedy_step", "cv_ensemble", "gram", "pca_recon", "mode_product",
    "complete_row_rank1", "pivot_columns", "doptimal_first", "design_criteria", "budget_pick", "cost_knn", "doubling_schedule",
    "stream_merge",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def names():
    return [n for n in entry.queries() if n in entry.oracle_sql()] if os.environ.get("PERFGRID_ALL") else QUICK


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, duck, name):
    result = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert result.startswith("ok"), result


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset_id", "cv_error", "n_folds"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
