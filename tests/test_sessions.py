"""Hand-made edge rows, brute force, and plan shapes."""

import itertools
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from roamlens.functions.times import ts
from roamlens.operators import chunks, metrics as M, regions, tree as R
from roamlens.operators.bins import densify, occupancy_bins
from roamlens.operators.copresence import copair_group, copair_pairs
from roamlens.operators.dims import Dims
from roamlens.operators.faculty import single_office_share
from roamlens.operators.grains import compute, metrics_bundle
from roamlens.operators.ordered import blocked_row_number, running_max
from roamlens.operators.overlap import _Side, dyadic_cells, overlap_join, overlap_self_join
from roamlens.operators.scope import entity_index
from tests.conftest import sessions

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def small_dims(spark, meta, faculty, regions_=()):
    rooms = sorted({r for r, _ in meta} | {r for r, _ in faculty} | {"A", "B"})
    return Dims(
        spark.createDataFrame([(i + 1, r, None, r) for i, r in enumerate(rooms)], "space_id INT, space_name STRING, parent_space_id INT, building_room STRING"),
        spark.createDataFrame([(1, i, t, r) for i, (r, t) in enumerate(meta)], "roomid INT, typeid INT, type STRING, building_room STRING"),
        spark.createDataFrame([(n, r) for r, n in faculty], "name STRING, office STRING"),
        spark.createDataFrame([(1, n, 1, s) for s, n in regions_] or [(1, "X", 1, "none")], "region_id INT, space_name STRING, wapcov_id INT, sensor STRING"),
    )


def bins_of(df):
    return {(r.space_id, r.interval_begin_time.strftime("%H:%M")): r.number_connections for r in df.collect()}


def test_bin_edges(spark):
    s = sessions(spark, [
        ("zero-inside", 1, "01:30", "01:30"), ("zero-on-edge", 2, "02:00", "02:00"), ("ends-on-edge", 3, "01:10", "02:00"),
        ("before-window", 4, "2024-01-01 23:00", "00:30"), ("twice", 5, "03:05", "03:10"), ("twice", 5, "03:40", "03:50"),
    ])
    got = bins_of(occupancy_bins(s, 3600, "2024-01-02 00:00:00", "2024-01-02 06:00:00"))
    assert got == {(1, "01:00"): 1, (3, "01:00"): 1, (4, "00:00"): 1, (5, "03:00"): 1}


def test_unaligned_window_keeps_clip(spark):
    s = sessions(spark, [("early", 1, "00:05", "00:15"), ("in", 1, "00:30", "02:30")])
    got = bins_of(occupancy_bins(s, 3600, "2024-01-02 00:20:00", "2024-01-02 02:40:00"))
    assert got == {(1, "00:00"): 1, (1, "01:00"): 1}


def test_densify_adds_zero_bins(spark):
    s = sessions(spark, [("a", 1, "01:00", "01:30"), ("a", 1, "04:00", "04:30")])
    got = bins_of(densify(occupancy_bins(s, 3600), 3600))
    assert got == {(1, "01:00"): 1, (1, "02:00"): 0, (1, "03:00"): 0, (1, "04:00"): 1}


def test_interval_is_checked(spark):
    with pytest.raises(ValueError):
        occupancy_bins(sessions(spark, [("a", 1, "01:00", "02:00")]), 1000)


def test_rollup_masks_below_a_source(spark):
    tree = spark.createDataFrame(
        [(1, None), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)], "space_id INT, parent_space_id INT")
    s = sessions(spark, [("a", 4, "01:00", "01:10"), ("a", 5, "01:20", "01:30"), ("b", 2, "01:00", "01:10"), ("c", 6, "01:00", "01:10")])
    got = bins_of(R.rollup_tree(occupancy_bins(s, 3600), tree, s))
    assert got == {(4, "01:00"): 1, (5, "01:00"): 1, (2, "01:00"): 1, (6, "01:00"): 1, (3, "01:00"): 1, (1, "01:00"): 2}
    distinct = bins_of(R.distinct_rollup(s, tree, 3600))
    assert distinct[(2, "01:00")] == 2 and distinct[(1, "01:00")] == 3


def test_fan_out_is_kept(spark):
    d = small_dims(spark, [("A", "office"), ("A", "student lab"), ("B", "kitchen")], [("A", "p1"), ("A", "p2")])
    s = sessions(spark, [("x", 1, "09:00", "09:30"), ("x", 2, "10:00", "10:30")])
    assert compute(M.faculty_office_share(), s, None, d).first().faculty_pct == 1.0
    assert compute(M.room_type_share(), s, None, d).first().percentage == 1.0
    assert compute(M.common_vs_work_rooms(), s, None, d).first().work_pct == 1.0
    assert single_office_share(s, None, d, 0.5).count() == 2
    assert compute(M.single_room_type(), s, None, d).count() == 0


def test_top_region_tie_goes_to_the_first_name(spark):
    d = small_dims(spark, [], [], [("ap-1", "B"), ("ap-2", "A"), ("ap-3", "NorthClassroom")])
    s = sessions(spark, [("x", 1, "10:00", "10:30"), ("x", 2, "11:00", "11:30"), ("x", 3, "12:00", "16:00")])
    assert regions.dominant_room(s, d, min_share=0.5).collect()[0].top_space_name == "A"


def test_bundle_equals_single_metrics(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(150):
        day, h, m = rng.randint(1, 20), rng.randint(0, 20), rng.randint(0, 59)
        rows.append((f"d{rng.randint(0, 4)}", rng.randint(1, 4), f"2024-01-{day:02d} {h:02d}:{m:02d}", f"2024-01-{day:02d} {h + rng.randint(0, 3):02d}:{m:02d}"))
    s = sessions(spark, rows)
    d = small_dims(spark, [("A", "office"), ("B", "student lab"), ("C", "meeting room"), ("D", "kitchen")], [("A", "p1")])
    make = [M.always_on, M.off_hours, M.many_rooms, M.few_rooms_non_faculty, M.office_and_lab_days, M.evening_departure, M.span_and_rooms, M.max_weekday_share]
    bundle = {r.mac_address: r for r in metrics_bundle(s, [f() for f in make], None, d).collect()}
    for f in make:
        for r in compute(f(), s, None, d).collect():
            for c in r.asDict():
                if c != "mac_address":
                    assert bundle[r.mac_address][f"{f().name}__{c}"] == r[c]


INTERVALS = st.lists(st.tuples(st.integers(0, 4), st.integers(1, 2), st.integers(0, 600), st.integers(0, 400)), min_size=2, max_size=25)


@FEW
@given(rows=INTERVALS, inclusive=st.booleans(), hot=st.sampled_from([1, 3, 1000]))
def test_overlap_join_equals_nested_loop(spark, rows, inclusive, hot):
    base = [(i, f"d{d}", p, a, a + n) for i, (d, p, a, n) in enumerate(rows)]
    df = spark.createDataFrame(base, "id INT, mac_address STRING, space_id INT, a INT, b INT").selectExpr(
        "id", "mac_address", "space_id", "timestampadd(MINUTE, a, TIMESTAMP_NTZ '2024-01-01') AS start_time",
        "timestampadd(MINUTE, b, TIMESTAMP_NTZ '2024-01-01') AS end_time")
    got = overlap_join(df, df, "space_id", inclusive, 7200, hot, F.col("l.mac_address") != F.col("r.mac_address"))
    got = sorted((r.l.id, r.r.id) for r in got.collect())
    hit = (lambda x, y: x[3] <= y[4] and y[3] <= x[4]) if inclusive else (lambda x, y: x[3] < y[4] and y[3] < x[4])
    want = sorted((x[0], y[0]) for x, y in itertools.product(base, base) if x[1] != y[1] and x[2] == y[2] and hit(x, y))
    assert got == want


def timed(spark, rows):
    """rows of (id, device, space, start and end in minutes)."""
    return spark.createDataFrame(rows, "id INT, mac_address STRING, space_id INT, a LONG, b LONG").selectExpr(
        "id", "mac_address", "space_id", "timestampadd(MINUTE, a, TIMESTAMP_NTZ '2024-01-01') AS start_time",
        "timestampadd(MINUTE, b, TIMESTAMP_NTZ '2024-01-01') AS end_time")


@FEW
@given(rows=INTERVALS, inclusive=st.booleans(), hot=st.sampled_from([1, 3, 1000]))
def test_overlap_self_join_finds_each_pair_once(spark, rows, inclusive, hot):
    base = [(i, f"d{d}", p, a, a + n) for i, (d, p, a, n) in enumerate(rows)]
    got = overlap_self_join(timed(spark, base), "space_id", "mac_address", inclusive, 1800, hot)
    got = sorted(tuple(sorted((r.l.id, r.r.id))) for r in got.collect())
    hit = (lambda x, y: x[3] <= y[4] and y[3] <= x[4]) if inclusive else (lambda x, y: x[3] < y[4] and y[3] < x[4])
    want = sorted((x[0], y[0]) for x, y in itertools.combinations(base, 2) if x[1] != y[1] and x[2] == y[2] and hit(x, y))
    assert got == want


@pytest.mark.parametrize("base", [-2**20 - 3, -40, 0, 7, 2**30 + 5])
def test_dyadic_cells_cover_exactly_their_slots(spark, base):
    rows = [(base + a, base + a + n) for a in range(9) for n in (-2, -1, 0, 1, 2, 3, 4, 5, 8, 30, 31, 64, 1000, 2**18 + 1)]
    df = spark.createDataFrame(rows, "a LONG, b LONG")
    for a, b, cells in df.select("a", "b", dyadic_cells(F.col("a"), F.col("b"), 1)).collect():
        blocks = sorted(((c >> 7) << (c & 63), 1 << (c & 63)) for c in cells)
        assert all(c >> 6 & 1 for c in cells)
        assert len(cells) <= max(4, 2 * (b - a + 1).bit_length())
        at = a
        for first, size in blocks:
            assert first == at
            at += size
        assert at == max(a, b + 1)


def test_a_session_of_thirty_years_stays_a_few_rows(spark):
    years = 30 * 365 * 24 * 60
    rows = [(0, "old", 1, -years, years), (1, "b", 1, 5, 20), (2, "c", 1, years - 5, years + 5), (3, "d", 2, 0, 10), (4, "bad", 1, 100, 50 - years)]
    s = timed(spark, rows)
    side = _Side(s, "l", ["space_id"], 3600)
    sizes = spark.createDataFrame([(1, 19, 19), (2, 0, 0)], "space_id INT, _t0 INT, _t1 INT")
    assert side.keyed(sizes, 19, None, 0).count() < 60 and side.keyed(sizes, 19, 0, None).count() <= 4 * 20 + 1
    got = overlap_join(s, s, "space_id", extra=F.col("l.mac_address") != F.col("r.mac_address"))
    assert sorted((r.l.id, r.r.id) for r in got.collect()) == [(0, 1), (0, 2), (0, 4), (1, 0), (2, 0), (4, 0)]


def test_a_place_with_many_long_intervals_is_cut_on_both_sides(spark):
    day = 24 * 60
    rows = [(i, f"d{i % 7}", 1, i % 11 - 2 * day, 3 * day + i) for i in range(60)] + [(60 + i, f"p{i % 5}", 1, i, i + 1) for i in range(80)]
    s = timed(spark, rows)
    long, short = s.where("id < 60"), s.where("id >= 60")
    want = sorted((x[0], y[0]) for x, y in itertools.product(rows[:60], rows[60:]) if x[3] < y[4] and y[3] < x[4])
    for hot in (10, 25, 1000):
        assert sorted((r.l.id, r.r.id) for r in overlap_join(long, short, "space_id", hot_rows=hot).collect()) == want
    # a cell with 60 intervals and 80 points becomes 6 parts by 8
    from roamlens.operators.overlap import _hot_cells

    sizes = spark.createDataFrame([(1, 7, 7)], "space_id INT, _t0 INT, _t1 INT")
    l = _Side(long, "l", ["space_id"], 3600).keyed(sizes, 7, None, 0)
    r = _Side(short, "r", ["space_id"], 3600).keyed(sizes, 7, 0, None)
    parts = {(h._l, h._r) for h in _hot_cells(l, r, ["space_id", "_cell"], 10).collect()}
    assert any(a == 6 and b == 8 for a, b in parts)


def test_touching_sessions(spark):
    s = sessions(spark, [("a", 1, "09:00", "10:00"), ("b", 1, "10:00", "11:00")])
    assert overlap_join(s, s, "space_id", extra=F.col("l.mac_address") != F.col("r.mac_address")).count() == 0
    assert overlap_join(s, s, "space_id", True, extra=F.col("l.mac_address") != F.col("r.mac_address")).count() == 2


@FEW
@given(chunk=st.lists(st.tuples(st.integers(0, 40), st.integers(1, 15)), max_size=8))
def test_gaps_and_chunks_make_up_the_window(spark, chunk):
    rows = [(1, 3600, a, a + n) for a, n in chunk]
    led = spark.createDataFrame(rows, "space_id INT, interval_seconds INT, a INT, b INT").selectExpr(
        "space_id", "interval_seconds", "timestampadd(HOUR, a, TIMESTAMP_NTZ '2024-01-01') AS chunk_start",
        "timestampadd(HOUR, b, TIMESTAMP_NTZ '2024-01-01') AS chunk_end", "'COMPLETED' AS status")
    spaces = spark.createDataFrame([(1,)], "space_id INT")
    gaps = chunks.coverage_gaps(led, spaces, 3600, "2024-01-01 05:00:00", "2024-01-02 12:00:00")
    hours = [(r.a, r.b) for r in gaps.select(*[F.timestamp_diff("HOUR", ts("2024-01-01 00:00:00"), F.col(c)).alias(n) for c, n in (("gap_start", "a"), ("gap_end", "b"))]).collect()]
    free = [h for a, b in hours for h in range(a, b)]
    covered = {h for _, _, a, b in rows for h in range(a, b)}
    assert len(free) == len(set(free)) and set(free) == {h for h in range(5, 36) if h not in covered}


def test_ordered_helpers_equal_plain_windows(spark):
    df = spark.range(400).selectExpr("id % 3 AS k", "id AS n", "(id * 7919) % 101 AS v")
    got = {(r.k, r.n): r.rn for r in blocked_row_number(df, ["k"], ["n"], F.floor(F.col("n") / 16)).collect()}
    up = {(r.k, r.n): r.m for r in running_max(df, ["k"], ["n"], "v", F.floor(F.col("n") / 16), "m").collect()}
    for k in range(3):
        best = None
        for i, n in enumerate(range(k, 400, 3)):
            assert got[(k, n)] == i + 1 and up[(k, n)] == best
            v = (n * 7919) % 101
            best = v if best is None else max(best, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copair_lists_every_pair_unless_a_share_is_asked(spark):
    s = sessions(spark, [("a", 1, "09:00", "10:00"), ("a", 2, "11:00", "12:00"), ("b", 1, "09:30", "11:00"), ("b", 2, "13:00", "13:10"), ("b", 3, "15:00", "15:10")])
    assert [(r.target_user, r.overlap_share) for r in copair_pairs(s).collect()] == [("a", 0.5)]
    assert copair_pairs(s, min_share=0.8).count() == 0


def test_overlap_plan_has_no_cross_join(spark):
    s = sessions(spark, [("a", 1, "09:00", "10:00"), ("b", 1, "09:30", "11:00")])
    p = plan(copair_pairs(s))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_bundle_meets_once_per_chain_on_the_device(spark):
    s = sessions(spark, [("a", 1, "09:00", "10:00")])
    p = plan(metrics_bundle(s, [M.always_on(), M.many_connections(), M.off_hours(), M.schedule_share(), M.connected_days()]))
    on_device = [line for line in p.splitlines() if "Exchange hashpartitioning(mac_address" in line and "day" not in line]
    assert len(on_device) == 1, p


def test_entity_index_needs_its_key(spark):
    with pytest.raises(ValueError):
        entity_index(spark.range(3), "mac_address")


def pairs_by_hand(rows, asked=None):
    """(target, other) -> overlapping session pairs, spaces and seconds, of (device, space, start, end) in minutes."""
    out = {}
    for d, sp, a, b in rows:
        for e, sq, x, y in rows:
            if None not in (d, e, sp, a, b, x, y) and sp == sq and d != e and a < y and x < b and (asked is None or d in asked):
                n, spaces, sec = out.get((d, e), (0, set(), 0))
                out[d, e] = (n + 1, spaces | {sp}, sec + 60 * (min(b, y) - max(a, x)))
    return {k: (n, len(s), float(sec)) for k, (n, s, sec) in out.items()}


@FEW
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from([1, 2, None]), st.integers(0, 90), st.sampled_from([0, 1, 7, 40, None])), max_size=60), st.booleans())
def test_device_pairs_by_blocks_are_whole(spark, rows, some):
    data = [(d, sp, a, None if n is None else a + n) for d, sp, a, n in rows]
    s = spark.createDataFrame(data, "mac_address STRING, space_id INT, a INT, b INT").selectExpr(
        "mac_address", "concat('ap-', space_id) AS sensor_id", "space_id",
        *[f"timestampadd(MINUTE, {c}, TIMESTAMP_NTZ '2024-01-30 23:30:00') AS {n}" for c, n in (("a", "start_time"), ("b", "end_time"))],
    )
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "mac_address STRING") if some else None
    want = pairs_by_hand(data, {"a", "b"} if some else None)
    total = {d: sum(r[0] == d for r in data) for d in "abcdefg"}
    spaces = {d: len({r[1] for r in data if r[0] == d} - {None}) for d in "abcdefg"}
    for role, sign in (("laptop", 1), ("phone", -1)):
        for size in (2, 100):
            got = {(r.target_user, r.other_user): (r.overlap_count, r.other_space_count, r.overlap_seconds) for r in copair_pairs(s, asked, role, group_devices=size).collect()}
            assert got == {(t, o): v for (t, o), v in want.items() if sign * (spaces[o] - spaces[t]) > 0 or sign * (total[o] - total[t]) > 0}


def test_device_pairs_are_not_shuffled(spark):
    s = sessions(spark, [("a", 1, "09:00", "10:00"), ("b", 1, "09:30", "11:00"), ("c", 1, "09:40", "11:00")])
    dims = small_dims(spark, [("A", "office")], [], [("ap-1", "North"), ("ap-1", "South")])
    for df in (copair_pairs(s), copair_group(s, dims, min_share=0.1)):
        above = plan(df).split("FlatMapGroupsInArrow")[0]
        assert "other" not in "".join(line for line in above.splitlines() if "Exchange" in line)
    rows = copair_group(s, dims, spark.createDataFrame([("b",)], "mac_address STRING"), min_share=0.5).collect()
    assert [(r.mac_address, r.space_name) for r in rows] == [("b", "North")]


def test_packed_sessions_travel_once_however_many_groups(spark):
    s = sessions(spark, [(d, 1, f"09:{k:02}", "11:00") for k, d in enumerate("abcdefgh")] + [("a", 2, "12:00", "13:00")])
    for asked in (None, spark.createDataFrame([("b",), ("c",)], "mac_address STRING")):
        df = copair_pairs(s, asked, group_devices=1)
        assert "explode" not in plan(df) and "hashpartitioning(block" not in plan(df)
        assert {(r.target_user, r.other_user) for r in df.collect()} == {(t, "a") for t in ("bcdefgh" if asked is None else "bc")}


def test_sessions_are_shuffled_once_for_packing_and_facts(spark, monkeypatch):
    from roamlens.operators import device_blocks as B

    packed, groups = [], B._groups
    monkeypatch.setattr(B, "_groups", lambda df, g: packed.append(df) or groups(df, g))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = sessions(spark, [(d, 1, f"09:{k:02}", "11:00") for k, d in enumerate("abcdefgh")] + [("a", 2, "12:00", "13:00")])
        df = copair_pairs(s, group_devices=3)
        moved = [line for line in plan(packed[0]).splitlines() if "Exchange hashpartitioning" in line]
        assert len(moved) == 3  # the sessions; their counts by place, then by device, for the facts
        assert {(r.target_user, r.other_user) for r in df.collect()} == {(t, "a") for t in "bcdefgh"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sessions_are_counted_before_names_multiply_them(spark, tmp_path):
    from roamlens.plans.block_queries import QUERIES

    tables = {
        "events": "SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-01' AS ts, id % 3 AS user_id, 1.0D AS value FROM range(90)",
        "region": "SELECT id AS r_regionkey, concat('r', id) AS r_name FROM range(5)",
        "nation": "SELECT id AS n_nationkey, concat('n', id) AS n_name, id % 5 AS n_regionkey FROM range(25)",
        "supplier": "SELECT id AS s_suppkey, concat('s', id % 40) AS s_name, id % 25 AS s_nationkey FROM range(1000)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    rooms, names = {}, {}
    for i in range(90):
        room = (i % 3 * 3 + i % (1 + i % 3 % 7)) % 25
        rooms[room, str(i % 3)] = rooms.get((room, str(i % 3)), 0) + 1
    for i in range(0, 1000, 10):
        names.setdefault(i % 25, []).append(f"s{i % 40}")
    chain, per_device = {}, {}
    for (room, device), n in rooms.items():
        for name in names.get(room, []):
            chain[f"n{room}", name] = chain.get((f"n{room}", name), 0) + n
        per_device[device] = per_device.get(device, 0) + n * len(names.get(room, []))
    for query, want in (("j01_dimension_chain", chain), ("j02_left_outer", per_device)):
        df = QUERIES[query](spark, str(tmp_path))
        assert {tuple(r)[:-1] if len(r) > 2 else r[0]: r[-1] for r in df.collect()} == want
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Aggregate \[[^\]]*space_id", text), text


def test_overlap_join_shuffles_each_session_for_one_direction(spark, tmp_path):
    from roamlens.plans.block_queries import QUERIES

    spark.sql("""SELECT id AS event_id, timestampadd(SECOND, CAST(id * 37 % 4000 * 10 AS INT), TIMESTAMP_NTZ '2024-01-01') AS ts,
        IF(id % 31 = 0, NULL, id % 9) AS user_id, IF(id % 5 = 0, 0, id % 90 * 1.0D) AS value FROM range(400)
        UNION ALL SELECT 1, TIMESTAMP_NTZ '2024-01-01 00:06:10', 1, 1.0D UNION ALL SELECT 1, NULL, 1, 1.0D""").write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["j06_overlap_join"](spark, str(tmp_path))
        got = sorted(tuple(r) for r in df.collect())
        text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        moved = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_cell" in line]
        assert len(moved) == 4 and sum("ReusedExchange" in line for line in moved) == 2, text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    from roamlens.sources import driver_tables as T

    rows = [r for r in T.sessions(spark, str(tmp_path)).collect() if None not in r]
    want = sorted(
        (t.mac_address, u.mac_address, t.space_id, t.start_time, u.start_time) for t in rows for u in rows
        if t.space_id == u.space_id and t.mac_address != u.mac_address and t.start_time < u.end_time and u.start_time < t.end_time
    )
    assert got == want and len(want) > 100


@settings(FEW, max_examples=5)
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from([1, 2, 3]), st.integers(0, 90), st.sampled_from([-2, 0, 1, 7, 40, 90])), max_size=60))
def test_pairs_with_a_share_and_groups_are_whole(spark, rows):
    from roamlens.operators import device_blocks as B

    data = [(d, sp, a, a + n) for d, sp, a, n in rows]
    s = spark.createDataFrame(data, "mac_address STRING, space_id INT, a INT, b INT").selectExpr(
        "mac_address", "concat('ap-', space_id) AS sensor_id", "space_id",
        *[f"timestampadd(MINUTE, {c}, TIMESTAMP_NTZ '2024-01-30 23:30:00') AS {n}" for c, n in (("a", "start_time"), ("b", "end_time"))],
    )
    total = {d: sum(r[0] == d for r in data) for d in "abcdefg"}
    spaces = {d: len({r[1] for r in data if r[0] == d}) for d in "abcdefg"}
    want = {
        k: v for k, v in pairs_by_hand(data).items()
        if v[0] / total[k[0]] >= 0.4 and (spaces[k[1]] > spaces[k[0]] or total[k[1]] > total[k[0]])
    }
    kept = B.CHUNK
    try:
        B.CHUNK = 3
        for size in (2, 100):
            got = copair_pairs(s, min_share=0.4, group_devices=size).collect()
            assert len(got) == len(want)
            assert {(r.target_user, r.other_user): (r.overlap_count, r.other_space_count, r.overlap_seconds) for r in got} == want
    finally:
        B.CHUNK = kept
    dims = small_dims(spark, [("A", "office")], [], [("ap-1", "North"), ("ap-1", "South"), ("ap-2", "East"), ("ap-3", "South")])
    fan = {1: ["North", "South"], 2: ["East"], 3: ["South"]}
    own, shared, freq = {}, {}, {}
    for d, sp, a, b in data:
        own[d] = own.get(d, 0) + b - a
    met = [
        (d, e, sp, min(b, y) - max(a, x)) for d, sp, a, b in data for e, sq, x, y in data
        if sp == sq and d != e and a < y and x < b
    ]
    for d, e, sp, both in met:
        shared[d, e] = shared.get((d, e), 0) + both * len(fan[sp])
    for d, e, sp, _ in met:
        if own[d] and shared[d, e] / own[d] >= 0.5:
            for region in fan[sp]:
                freq[d, region] = freq.get((d, region), 0) + 1
    best = {d: max(n for (x, _), n in freq.items() if x == d) for d, _ in freq}
    got = copair_group(s, dims, min_share=0.5, group_devices=3).collect()
    assert {r.mac_address: freq[r.mac_address, r.space_name] for r in got} == best


def test_groups_of_devices_are_packed_once(spark):
    from roamlens.operators import device_blocks as B

    packed = spark.range(40).selectExpr("CAST(id % 8 AS STRING) AS mac_address", "id AS x")
    groups = B._groups(packed, 4)
    assert groups.is_cached  # each block of a group reads it again
    assert sum(1 for _ in groups.collect()) == len({g for g, _ in groups.collect()})
