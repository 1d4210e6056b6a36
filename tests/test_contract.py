"""The entry file: registered queries agree with their SQL on the smallest tables."""

import pathlib

import pytest

import __spark_entry__ as contract
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
QUICK = [
    "integrate_station_mobile", "pivot_readings_mean", "hourly_rollup_stats", "calendar_features", "two_regime_scoring",
    "prediction_writeback", "best_models", "kruskal_h", "holm_matrix", "wilcoxon_signed", "exact_train_test_split",
    "contiguous_fold_numbers", "scale_robust", "rare_target_augment", "kde_by_category", "fit_knn", "results_json_flatten",
]


def test_names_match():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are not here")
def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns[-1] == "PM10_ARPA"


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, name):
    df = contract.queries()[name](spark, SF)
    assert differences(df, duck(SF), contract.oracle_sql()[name]) is None
