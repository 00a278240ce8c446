"""Plans that must hold at any table size."""

import pytest

from sparktab.plans import catalog

SF = "/root/testdata/sf0.001"
ROW_LEVEL = ["stratified_split", "stratified_folds", "design_matrix", "standard_scale", "class_filter"]
NO_PYTHON = [
    "metric_payload",
    "roc_curve",
    "experiment_rollup",
    "describe_categorical",
    "histogram_15",
    "pair_grid",
    "score_saved_model",
    "runs_list",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_row_level_operators_do_not_shuffle_rows(spark, name):
    text = plan_of(catalog.QUERIES[name](spark, SF))
    assert "hashpartitioning" not in text and "SinglePartition" not in text


@pytest.mark.parametrize("name", NO_PYTHON)
def test_stays_in_the_engine_without_cross_joins(spark, name):
    text = plan_of(catalog.QUERIES[name](spark, SF))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_scan_reads_only_what_is_needed(spark):
    text = plan_of(catalog.QUERIES["classification_metrics"](spark, SF))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in text
    text = plan_of(catalog.QUERIES["class_filter"](spark, SF))
    assert "PushedFilters: [In(label, [1,3,5])]" in text
