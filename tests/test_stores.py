"""Refresh in pieces and the stream twin against a full recompute."""

import pytest
from pyspark.sql import functions as F

from roamlens.operators import bin_store as S, tree as R
from roamlens.operators.bins import occupancy_bins
from roamlens.sources import driver_tables as T
from roamlens.streaming.occupancy_stream import read_session_stream, start_occupancy_stream
from tests.conftest import sessions

SF = "/root/testdata/sf0.001"


def full(spark):
    return R.rollup_tree(occupancy_bins(T.sessions(spark, SF), 3600), T.space(spark, SF), T.sessions(spark, SF))


def same(spark, path, want):
    got = S.read_bins(spark, path).select("space_id", "interval_begin_time", "number_connections")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_refresh_in_pieces(spark, tmp_path):
    s, tree, path = T.sessions(spark, SF), T.space(spark, SF), str(tmp_path / "bins")
    S.refresh_occupancy(s, tree, 1, path, 3600, "2024-01-01 00:00:00", "2024-01-12 05:00:00", "2024-03-01 00:00:00")
    S.refresh_occupancy(s, tree, 1, path, 3600, "2024-01-01 00:00:00", "2024-02-10 00:00:00", "2024-03-01 00:00:00")
    same(spark, path, full(spark))


def test_stream_with_late_files(spark, tmp_path):
    s = T.sessions(spark, SF)
    late = F.pmod(F.xxhash64("start_time"), F.lit(4)) == 0
    for part in (s.where(~late), s.where(late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start_occupancy_stream(
        read_session_stream(spark, str(tmp_path / "in"), 1), T.space(spark, SF), str(tmp_path / "store"), str(tmp_path / "bins"), 3600, str(tmp_path / "ck"),
    ).awaitTermination()
    same(spark, str(tmp_path / "bins"), full(spark))


TREE = [(1, None), (10, 1), (11, 1), (100, 10), (101, 11)]
WINDOW = ("2024-01-02 00:00:00", "2024-01-05 00:00:00")


def campus(spark, *more):
    tree = spark.createDataFrame(TREE, "space_id INT, parent_space_id INT")
    rows = [("a", 100, "09:10", "09:50"), ("b", 101, "09:20", "09:40"), ("c", 101, "2024-01-03 09:20", "2024-01-03 09:40")]
    return tree, sessions(spark, rows + list(more))


def counts(bins):
    return {(r.space_id, r.interval_begin_time.day): r.number_connections for r in bins.collect()}


def test_refresh_of_two_roots_keeps_the_sums_above_them(spark, tmp_path):
    path, done = str(tmp_path / "bins"), "2024-02-01 00:00:00"
    tree, s = campus(spark)
    S.refresh_occupancy(s, tree, 10, path, 3600, *WINDOW, done)
    assert counts(S.read_bins(spark, path)) == {(1, 2): 1, (10, 2): 1, (100, 2): 1}
    S.refresh_occupancy(s, tree, 11, path, 3600, *WINDOW, done)
    both = {(1, 2): 2, (10, 2): 1, (100, 2): 1, (11, 2): 1, (101, 2): 1, (1, 3): 1, (11, 3): 1, (101, 3): 1}
    assert counts(S.read_bins(spark, path)) == both
    # the sessions of a day are withdrawn; nothing but a forced refresh can see that
    S.refresh_occupancy(s.where("mac_address <> 'c'"), tree, 11, path, 3600, *WINDOW, done)
    assert counts(S.read_bins(spark, path)) == both
    S.refresh_occupancy(s.where("mac_address <> 'c'"), tree, 11, path, 3600, *WINDOW, done, force=True)
    assert counts(S.read_bins(spark, path)) == {k: v for k, v in both.items() if k[1] == 2}
    snapshot = S.BinStore(spark, path).snapshot()
    assert set(snapshot.parts) == {"3600/2024-01-02"}  # the empty day has no file


def test_a_new_source_above_stored_ones_masks_them_on_all_days(spark, tmp_path):
    path, done = str(tmp_path / "bins"), "2024-02-01 00:00:00"
    tree, s = campus(spark)
    S.refresh_occupancy(s, tree, 1, path, 3600, *WINDOW, done)
    tree, grown = campus(spark, ("d", 11, "2024-01-04 10:10", "2024-01-04 10:20"))
    S.refresh_occupancy(grown, tree, 1, path, 3600, *WINDOW, done, force=True)
    want = R.rollup_tree(occupancy_bins(grown, 3600), tree, grown)
    same(spark, path, want)
    assert (1, 3) not in counts(want) and (11, 4) in counts(want)


def test_late_sessions_are_counted_by_the_next_refresh(spark, tmp_path):
    path = str(tmp_path / "bins")
    tree, early = campus(spark)
    S.refresh_occupancy(early, tree, 1, path, 3600, *WINDOW, "2024-01-02 10:00:00")
    assert S.BinStore(spark, path).snapshot().ledger().where("status = 'COMPLETED'").count() == 5
    tree, late = campus(spark, ("d", 100, "09:30", "10:40"))
    S.refresh_occupancy(late, tree, 1, path, 3600, *WINDOW, "2024-01-04 00:00:00")
    same(spark, path, R.rollup_tree(occupancy_bins(late, 3600), tree, late))
    ledger = S.BinStore(spark, path).snapshot().ledger()
    assert ledger.groupBy("space_id").count().where("count > 1").count() == 0  # stale chunks are gone


@pytest.mark.parametrize("at", ["ledger", "commit"])
def test_a_refresh_that_fails_changes_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch, at):
    path, done = str(tmp_path / "bins"), "2024-02-01 00:00:00"
    tree, s = campus(spark)
    S.refresh_occupancy(s, tree, 10, path, 3600, *WINDOW, done)
    before, ledger = counts(S.read_bins(spark, path)), S.BinStore(spark, path).snapshot().ledger().count()

    def broken(self, *args, **kw):
        if at == "commit" or args[1] == "ledger":
            raise OSError("lost")
        return write(self, *args, **kw)

    name = "commit" if at == "commit" else "write_table"
    write = getattr(S.BinStore, name)
    with monkeypatch.context() as m:
        m.setattr(S.BinStore, name, broken)
        with pytest.raises(OSError):
            S.refresh_occupancy(s, tree, 1, path, 3600, *WINDOW, done)
    assert counts(S.read_bins(spark, path)) == before and S.BinStore(spark, path).snapshot().ledger().count() == ledger
    (tmp_path / "bins" / "manifests" / "000000000009.json").write_text('{"parts": {"3600/20')  # torn
    assert counts(S.read_bins(spark, path)) == before
    S.refresh_occupancy(s, tree, 1, path, 3600, *WINDOW, done)
    same(spark, path, R.rollup_tree(occupancy_bins(s, 3600), tree, s))


def test_readers_keep_their_snapshot_and_writers_notice_each_other(spark, tmp_path):
    path, done = str(tmp_path / "bins"), "2024-02-01 00:00:00"
    tree, s = campus(spark)
    store = S.BinStore(spark, path)
    S.refresh_occupancy(s, tree, 10, path, 3600, *WINDOW, done)
    opened = store.snapshot()
    S.refresh_occupancy(s, tree, 1, path, 3600, *WINDOW, done)
    assert counts(opened.bins()) == {(1, 2): 1, (10, 2): 1, (100, 2): 1}
    with pytest.raises(RuntimeError, match="changed"):
        store.commit(opened, {})
    assert store.snapshot(opened.version).parts == opened.parts
    assert store.vacuum(keep=2) == 0 and store.vacuum() > 0
    same(spark, path, R.rollup_tree(occupancy_bins(s, 3600), tree, s))


def test_only_days_with_changes_are_written(spark, tmp_path):
    path, done = str(tmp_path / "bins"), "2024-02-01 00:00:00"
    tree, s = campus(spark)
    S.refresh_occupancy(s, tree, 1, path, 3600, *WINDOW, done)
    first = S.BinStore(spark, path).snapshot()
    tree, more = campus(spark, ("d", 100, "2024-01-03 11:00", "2024-01-03 11:30"))
    S.refresh_occupancy(more, tree, 1, path, 3600, *WINDOW, done, force=True)
    second = S.BinStore(spark, path).snapshot()
    assert first.parts["3600/2024-01-02"] == second.parts["3600/2024-01-02"]
    assert first.parts["3600/2024-01-03"] != second.parts["3600/2024-01-03"]
    files = second.bins(3600, [r.day for r in second.bins().select("day").distinct().collect()][:1]).inputFiles()
    assert files and len({f.split("day=")[1][:10] for f in files}) == 1


def test_deep_trees_cycles_and_pages(spark):
    from roamlens.operators.scope import preview

    n = 200
    chain = spark.range(1, n + 1).selectExpr("CAST(id AS INT) AS space_id", "CAST(nullif(id - 1, 0) AS INT) AS parent_space_id")
    got = R.closure(chain)
    assert got.count() == n * (n + 1) // 2 and got.where("depth <> descendant - ancestor").count() == 0
    assert R.descendants(chain, 1).count() == n and R.ancestors(chain, n).count() == n
    with pytest.raises(ValueError):
        R.closure(spark.createDataFrame([(1, 2), (2, 1)], "space_id INT, parent_space_id INT"))
    with pytest.raises(ValueError):
        preview(chain, "space_id", 2000)
