"""Hard negatives against brute force in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roamlens.llm import hard_negatives as H
from roamlens.llm.queries import op12_hard_negatives

SCHEMA = "vec_id LONG, label INT, vector ARRAY<DOUBLE>, slot INT, score DOUBLE, id LONG, anchor STRING, `a.b` INT"


def brute(rows, is_anchor, scale=256.0, k=5, m=10, low=30, high=90):
    usable = []
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, label, tuple(math.floor(scale * x) for x in v)))
    out = set()
    for i, label, v in {r for r in usable if is_anchor(r[0])}:
        scored = {(-sum(a * b for a, b in zip(v, w)), j, same == label) for j, same, w in usable if j != i}
        near = sorted((s, j) for s, j, same in scored if same)[:k]
        for s, j in near:
            far = sorted((t, n) for t, n, same in scored if not same and low * -s <= 100 * -t <= high * -s)[:m]
            out |= {(i, j, r, n, -s, -t) for r, (t, n) in enumerate(far, 1)}
    return sorted(out)


def mined(spark, rows, is_anchor, parts=3, **more):
    data = [(*r, 1, 0.5, 3, "x", 2) for r in rows]
    items = spark.createDataFrame(data, SCHEMA).repartition(parts)
    got = H.mine_hard_negatives(items, is_anchor, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n=300, dims=5, size=1.0, seed=3):
    r = random.Random(seed)
    rows = [(i, r.randrange(3), [r.uniform(-size, size) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, i % 2, [size] * dims) for i in range(60)]  # one vector many times: ties
    rows += [(2000, 1, [size] * dims), (2000, 1, [size] * dims), (2000, 2, [0.0] * dims), (10, 0, [size / 2] * dims)]
    rows += [(2010, None, [1.0]), (2020, 1, None), (2030, 1, [None, 1.0]), (2040, 0, [math.nan]), (2050, 0, [math.inf])]
    rows += [(None, 1, [size] * dims), (2060, 1, []), (2070, 2, [size, size]), (-40, 1, [size / 3] * dims)]
    return rows


@pytest.mark.parametrize("size", [1.0, 300_000.0])
def test_mined_equals_brute_force(spark, size):
    rows = vectors(size=size)
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)


def test_blocks_of_anchors_and_tiles_do_not_change_the_result(spark, monkeypatch):
    rows = vectors(dims=3, seed=5)
    for name, value in (("BLOCK_BYTES", 400), ("ROWS", 7), ("ANCHORS", 3)):
        monkeypatch.setattr(H, name, value)
    assert mined(spark, rows, F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i % 50 == 0)


def test_other_sizes_and_windows(spark):
    rows = vectors(n=80, seed=9)
    got = mined(spark, rows, F.col("vec_id") < 9, positives=2, negatives=3, low=-50, high=120, scale=16.0)
    assert got == brute(rows, lambda i: i < 9, 16.0, 2, 3, -50, 120)


def test_products_are_exact_up_to_62_bits():
    r = np.random.default_rng(1)
    for size, dims in ((100, 64), (2**20, 3000), (2**29, 7)):
        a, b = r.integers(-size, size, (5, dims)), r.integers(-size, size, (6, dims))
        primes = H.moduli(dims * size * size)
        got = H.products(H.residues(a.astype(float), primes), H.residues(b.astype(float), primes), primes)
        assert got.tolist() == (a.astype(object) @ b.T.astype(object)).tolist()


def test_empty_tables_and_scores_beyond_64_bits(spark):
    assert mined(spark, [], F.lit(True)) == []
    assert mined(spark, [(1, 1, [1.0])], F.lit(False)) == []
    with pytest.raises(ValueError, match="64-bit"):
        mined(spark, [(1, 1, [1e12]), (2, 1, [1e12])], F.lit(True))


def test_query_on_the_sample_tables(spark):
    got = op12_hard_negatives(spark, "/root/testdata/sf0.001")
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + (r.vec_id % 7 == 0)) % 10, r.embedding) for r in table]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 100 == 0)
