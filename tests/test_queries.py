"""A spread of the registered queries against their SQL; tools/check.py runs all of them."""

import pytest

import __spark_entry__ as entry_module
from tests.conftest import SMALL
from tools.check import compare, oracle_connection

PICKED = [
    "p07_clean_table", "p14_engineered_features", "f07_stratified_folds", "c08_top_rates_by_level",
    "c09_describe", "c11_column_profile", "c16_categorical_summary", "c22b_histogram_by_label",
    "c23_box_statistics", "c40_top_levels", "t01_chi_square", "t05_anova", "t08_effect_summary",
    "e03_nearest_controls", "e04_stratified_effect", "e05b_adjusted_level_contrasts", "v02_roc_auc",
    "v07_classification_report", "v10_threshold_sweep", "m04_one_hot_levels",
]


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, duck, name):
    sql = entry_module.oracle_sql()[name]
    state, note, _ = compare(spark, duck, SMALL, name, entry_module.queries()[name], sql)
    assert state == "ok", note


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 140


@pytest.mark.parametrize("name", ["c13b_duplicate_rows_all_columns", "c14b_constant_columns_all_columns"])
def test_all_columns_equal_sql(spark, duck, name):
    state, note, _ = compare(spark, duck, SMALL, name, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert state == "ok", note
