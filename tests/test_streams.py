"""The stateful occupancy stream against a batch job."""

import pytest
from pyspark.sql import functions as F

from roamlens.operators import bin_store as S, tree as R
from roamlens.operators.bins import occupancy_bins
from roamlens.plans.occupancy_queries import inner_sessions
from roamlens.sources import driver_tables as T
from roamlens.streaming.occupancy_state import add_changes, start_stateful_occupancy
from roamlens.streaming.occupancy_stream import read_session_stream
from tests.conftest import sessions

SF = "/root/testdata/sf0.001"
TREE = [(1, None), (10, 1), (100, 10), (101, 10)]


def rows(df):
    return sorted(map(tuple, df.select("space_id", "interval_begin_time", "number_connections").collect()))


@pytest.mark.parametrize("files,parts,keep", [(100, 1, None), (1, 3, None), (2, 2, 60)])
def test_result_does_not_depend_on_micro_batches(spark, tmp_path, files, parts, keep):
    s, tree = inner_sessions(spark, SF), T.space(spark, SF)
    for k in range(3):  # early and late sessions are dealt over the files
        s.where(F.pmod(F.xxhash64("start_time", "mac_address"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start_stateful_occupancy(
        read_session_stream(spark, str(tmp_path / "in"), files), tree, str(tmp_path / "bins"), 3600, str(tmp_path / "ck"), parts, keep
    ).awaitTermination()
    want = R.rollup_tree(occupancy_bins(s, 3600), tree, s)
    assert rows(S.read_bins(spark, str(tmp_path / "bins"))) == rows(want)


def test_devices_seen_before_and_restarts(spark, tmp_path):
    tree = spark.createDataFrame(TREE, "space_id INT, parent_space_id INT")
    first = sessions(spark, [("a", 100, "09:10", "10:20"), ("b", 101, "09:30", "09:40")])
    again = sessions(spark, [("a", 100, "09:40", "09:50"), ("c", 100, "09:00", "09:05"), ("d", 10, "2024-01-05 23:30", "2024-01-06 00:30")])
    for arriving in (first, again):  # the second start goes on from the checkpoint
        arriving.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start_stateful_occupancy(
            read_session_stream(spark, str(tmp_path / "in")), tree, str(tmp_path / "bins"), 3600, str(tmp_path / "ck")
        ).awaitTermination()
    both = first.unionByName(again)
    assert rows(S.read_bins(spark, str(tmp_path / "bins"))) == rows(R.rollup_tree(occupancy_bins(both, 3600), tree, both))


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    tree = spark.createDataFrame(TREE, "space_id INT, parent_space_id INT")
    batch = occupancy_bins(sessions(spark, [("a", 100, "09:10", "10:20")]), 3600).withColumnRenamed("number_connections", "change")
    run = add_changes(tree, str(tmp_path / "bins"), 3600, "s")
    run(batch, 0)
    once = rows(S.read_bins(spark, str(tmp_path / "bins")))
    run(batch, 0)
    assert rows(S.read_bins(spark, str(tmp_path / "bins"))) == once
    run(batch, 1)
    assert [r[2] for r in rows(S.read_bins(spark, str(tmp_path / "bins")))] == [2] * len(once)


def test_state_of_past_days_is_dropped(spark, tmp_path):
    tree = spark.createDataFrame(TREE, "space_id INT, parent_space_id INT")
    days = [sessions(spark, [("a", 100, f"2024-01-{d:02d} 09:10", f"2024-01-{d:02d} 09:20")]) for d in (2, 10, 20)]
    for s in days:
        s.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start_stateful_occupancy(
            read_session_stream(spark, str(tmp_path / "in"), 1), tree, str(tmp_path / "bins"), 3600, str(tmp_path / "ck"), 1, keep_days=3
        ).awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "ck"))
    held = {r[0] for r in state.select("key.day").collect()}
    assert held == {19742}  # 2024-01-20 alone, days 2 and 10 are more than three days past
    assert len(rows(S.read_bins(spark, str(tmp_path / "bins")))) == 9
