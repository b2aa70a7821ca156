"""A cross-section of the registered queries against their SQL; all of them
run with check_oracles.py."""

import pytest

import __spark_entry__ as entry
from roamlens.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = [
    "m01_always_on", "m05_single_room_type", "m06_off_hours", "m08_copair_phone", "m11_room_type_share",
    "m15_many_rooms_three", "m20_lab_day_share", "m25_few_rooms_non_faculty", "m26_faculty_office_share",
    "m31_shared_rooms", "m42_copair_group", "m43_device_features", "s07_bind_query", "s10_profile_columns",
    "j06_overlap_join", "j07_overlap_left_join", "b01_occupancy_bins_clipped", "k03_rollup_tree",
    "k05_stale_chunks", "k06_coverage_gaps", "l01_level1_votes", "l06_lf_summary", "l10_predict_proba",
    "c03_cap_imbalance", "c09_nearest_neighbours", "h02_fill_bounded", "h11_sequences",
    "k01_preorder_ranges", "k03_rollup_inner_sources", "k04_distinct_bitmaps", "k07_delta_rollup", "c09_pruned_neighbours",
    "c11_expression_score", "l04_batch_votes", "l14_lf_accuracy_gold", "s08_seek_page", "s08_seek_after", "h13_forecast_errors",
    "h15_forecast_rollout",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert ok, note


def test_every_query_has_sql_or_is_a_model():
    without = set(registry.queries()) - set(registry.oracle_sql())
    assert without == {"c08_train_bank", "c11_batch_score", "h09_seasonal_forecast", "h12_autoregressive_forecast"}
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 15
