"""Reach, preorder labels and rollups of trees, walked locally and by doubling steps."""

import random
import time

import pytest
from pyspark.sql import functions as F

from roamlens.operators import tree as R
from roamlens.operators.bins import occupancy_bins
from tests.conftest import sessions

SCHEMA = "space_id INT, parent_space_id INT"


def chain(spark, n):
    return spark.range(1, n + 1).selectExpr("CAST(id AS INT) AS space_id", "CAST(nullif(id - 1, 0) AS INT) AS parent_space_id")


def random_tree(seed, n=60):
    r = random.Random(seed)
    ids = r.sample(range(1000), n)
    return [(v, None if i == 0 or r.random() < 0.05 else ids[r.randrange(max(0, i - 7), i)]) for i, v in enumerate(ids)] + [(2000, 3000)]


def pairs_of(rows):
    up = dict(rows)
    found = set()
    for v in up:
        at, depth = v, 0
        while at is not None:
            found.add((v, at, depth))
            at, depth = up.get(at), depth + 1
    return found


@pytest.fixture(params=["local", "doubling"])
def walk(request, monkeypatch):
    if request.param == "doubling":
        monkeypatch.setattr(R, "LOCAL_NODES", 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_equals_walking(spark, walk, seed):
    rows = random_tree(seed)
    tree, nodes = spark.createDataFrame(rows, SCHEMA), {v for v, _ in rows}
    want = pairs_of(rows)
    assert {tuple(r) for r in R.closure(tree).collect()} == want
    for v in (rows[0][0], rows[30][0], rows[-2][0], 2000, -5):
        below = {(d, depth) for d, a, depth in want if a == v and a in nodes}
        above = {(a, depth) for d, a, depth in want if d == v and a in nodes}
        assert {tuple(r) for r in R.descendants(tree, v).collect()} == below
        assert {tuple(r) for r in R.ancestors(tree, v).collect()} == above


@pytest.mark.parametrize("seed", [3, 4])
def test_preorder_makes_subtrees_ranges(spark, seed):
    rows = random_tree(seed)
    tree = spark.createDataFrame(rows, SCHEMA)
    labels = R.preorder(tree)
    got = {r.space_id: (r.depth, r.first, r.last) for r in labels.collect()}
    kids, place = {}, {}
    nodes = {v for v, _ in rows}
    for v, p in sorted(rows):
        kids.setdefault(p if p in nodes else None, []).append(v)

    def walk(v, depth):
        first = len(place)
        place[v] = None
        for c in kids.get(v, []):
            walk(c, depth + 1)
        place[v] = (depth, first, len(place) - 1)

    for v in kids[None]:
        walk(v, 0)
    assert got == place
    for v in (rows[0][0], rows[9][0], 2000):
        assert sorted(map(tuple, R.in_subtree(labels, v).collect())) == sorted(map(tuple, R.descendants(tree, v).collect()))
    assert R.in_subtree(labels, -1).count() == 0


def test_one_node_of_a_long_chain(spark):
    """No table of all pairs: the chain has 5 * 10^9 of them."""
    tree, n, t = chain(spark, 100_000), 100_000, time.time()
    up = R.ancestors(tree, n).agg(F.count("*"), F.max("depth")).first()
    assert tuple(up) == (n, n - 1)
    assert R.ancestors(tree, 3).count() == 3
    assert R.descendants(tree, n - 9).count() == 10
    assert time.time() - t < 240


def test_cycles_are_errors(spark, walk):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], SCHEMA)
    for ask in (lambda: R.closure(ring), lambda: R.ancestors(ring, 4), lambda: R.descendants(ring, 1), lambda: R.preorder(ring)):
        with pytest.raises(ValueError, match="cycle"):
            ask()


def test_sources_in_inner_nodes_mask_on_every_day(spark, walk):
    tree = spark.createDataFrame([(1, None), (10, 1), (100, 10)], SCHEMA)
    s = sessions(spark, [("a", 10, "09:10", "09:50"), ("b", 100, "2024-01-03 09:20", "2024-01-03 09:40")])
    bins = occupancy_bins(s, 3600)
    whole = R.rollup_tree(bins, tree, s)
    second = F.to_date("interval_begin_time") == "2024-01-03"
    assert {(r.space_id, r.number_connections) for r in whole.where(second).collect()} == {(100, 1)}
    alone = R.rollup_tree(bins.where(second), tree, s)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, whole.where(second).collect()))


def test_delta_rollup_follows_changes_and_new_sources(spark):
    r = random.Random(5)
    rows = random_tree(6, 25)
    tree, ids = spark.createDataFrame(rows, SCHEMA), [v for v, _ in rows]
    bins = lambda spaces, seed: spark.createDataFrame(
        [(v, f"2024-01-01 {h:02d}:00:00", random.Random(v * 31 + h * seed).randint(0, 4)) for v in spaces for h in range(4)],
        "space_id INT, t STRING, number_connections LONG",
    ).selectExpr("space_id", "CAST(t AS TIMESTAMP_NTZ) AS interval_begin_time", "number_connections").where("number_connections > 0")
    before, after = r.sample(ids, 8), r.sample(ids, 6)
    grown = sorted(set(before) | set(after))
    src = lambda v: spark.createDataFrame([(x,) for x in v], "space_id INT")
    old, new = bins(before, 1), bins(grown, 2)
    flows = R.source_flows(tree, src(before)), R.source_flows(tree, src(grown))
    delta = R.delta_rollup(R.bin_changes(old, new), flows[1], R.flow_changes(*flows), old)
    total = R.rollup_tree(old, tree, src(before)).unionByName(delta.withColumnRenamed("change", "number_connections"))
    got = total.groupBy(*R.BIN).agg(F.sum("number_connections").alias("n")).where("n <> 0")
    want = R.rollup_tree(new, tree, src(grown))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
