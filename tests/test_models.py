"""Votes, label model, subsets, training table, series."""

import math

import pytest
from pyspark.sql import functions as F

from roamlens.operators import label_model as LM, timeline as TL, training as TR, vote_stats as V
from roamlens.operators.evaluation import scores
from roamlens.operators.neighbors import knn_predict
from roamlens.operators.subsets import Level, derive_entities, run_hierarchy
from roamlens.operators.votes import label_matrix, lf_predicate, lf_python


@pytest.fixture(scope="module")
def votes(spark):
    rows = [("a", [0, 1, -1]), ("b", [0, 0, 1]), ("c", [-1, -1, -1]), ("d", [0, -1, -1])]
    return spark.createDataFrame(rows, "mac_address STRING, votes ARRAY<INT>")


def test_missing_and_null_metrics_abstain(spark):
    ents = spark.createDataFrame([("a",), ("b",), ("c",)], "mac_address STRING")
    metric = spark.createDataFrame([("a", 0.9), ("b", None)], "mac_address STRING, p DOUBLE")
    got = {r.mac_address: r.votes for r in label_matrix(ents, [(metric, [lf_predicate("x", 2, F.col("p") > 0.5, (2, 5))])]).collect()}
    assert got == {"a": [0], "b": [-1], "c": [-1]}


def test_python_votes_abstain_per_row(spark):
    metric = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "mac_address STRING, n INT")
    lf = lf_python("f", lambda r: [1 / r["n"], 7, 3][int(r["n"])] if r["n"] else 1 / r["n"], ["n"], (3,))
    got = {r.mac_address: r.votes for r in label_matrix(metric, [(metric, [lf])]).collect()}
    assert got == {"a": [-1], "b": [-1], "c": [0]}


def test_summary_and_majority(votes):
    pats = V.patterns(votes)
    s = {r.lf_index: r for r in V.lf_summary(pats, ["x", "y", "z"]).collect()}
    assert (s[0].coverage, s[0].overlaps, s[0].conflicts, s[0].n_votes) == (0.75, 0.5, 0.5, 3)
    assert s[2].polarity == [1] and s[2].conflicts == 0.5
    assert {r.mac_address: r.label for r in V.majority_vote(votes, 2).collect()} == {"a": 0, "b": 0, "c": -1, "d": 0}
    assert {r.class_name: r.entities for r in V.class_distribution(pats, ["A", "B"]).collect()} == {"A": 3, "B": 0, "ABSTAIN": 1}


def test_label_model_equals_plain_em(votes):
    model = LM.fit_label_model(V.patterns(votes), 3, 2, epochs=5)
    rows = [[0, 1, -1], [0, 0, 1], [-1, -1, -1], [0, -1, -1]]
    p = [[[0.7 if v == c else 0.15 for v in (-1, 0, 1)] for c in (0, 1)] for _ in range(3)]

    def post(r):
        w = [math.prod(p[j][c][r[j] + 1] for j in range(3)) for c in (0, 1)]
        return [x / sum(w) for x in w]

    for _ in range(5):
        q = [post(r) for r in rows]
        new = []
        for j in range(3):
            table = []
            for c in (0, 1):
                n = [1 + sum(q[i][c] for i, r in enumerate(rows) if r[j] == v) for v in (-1, 0, 1)]
                table.append([x / sum(n) for x in n])
            new.append(table)
        p = new
    for j in range(3):
        for c in (0, 1):
            assert [math.exp(x) for x in model.log_p[j][c]] == pytest.approx(p[j][c])
    probs = {r.mac_address: r.probs for r in LM.predict_proba(votes, model).collect()}
    assert all(sum(x) == pytest.approx(1.0) for x in probs.values())
    assert probs["a"] == pytest.approx(post(rows[0]))


def test_subsets(spark):
    ents = spark.createDataFrame([("a",), ("b",), ("c",)], "mac_address STRING")
    preds = spark.createDataFrame([("a", [0.9, 0.1]), ("b", [0.5, 0.5]), ("c", [0.2, 0.8])], "mac_address STRING, probs ARRAY<DOUBLE>")

    def names(rule, **kw):
        return sorted(r.mac_address for r in derive_entities(ents, preds, rule, [4, 7], **kw).collect())

    assert names(None) == ["a", "b", "c"]
    assert names({"labels": {"4": {"min_confidence": 0.8}}}) == ["a"]
    assert names('{"labels": {"4": {"min_confidence": 0.8}, "7": {"min_confidence": 0.8}}}') == ["a", "c"]
    assert names({"labels": {"4": {}}}) == ["a", "b", "c"]
    assert names({"labels": {"4": {}}}, mode="argmax") == ["a", "b"]
    assert names({"labels": {"99": {"min_confidence": 0.1}}}) == []


def test_level_needs_its_parent(spark):
    ents = spark.createDataFrame([("a",)], "mac_address STRING")
    with pytest.raises(ValueError):
        run_hierarchy(ents, [Level("second", lambda e: [], {}, parent="people")])


def test_entropy_confidence(spark):
    df = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [1.0, 0.0])], "mac_address STRING, probs ARRAY<DOUBLE>")
    got = {r.mac_address: r.c for r in df.select("mac_address", TR.confidence("probs", "entropy").alias("c")).collect()}
    assert got["a"] == pytest.approx(0.0, abs=1e-8) and got["b"] == pytest.approx(1.0, abs=1e-8)


def test_threshold_goes_down_until_classes_are_big_enough(spark):
    rows = [(f"a{i}", 0, 0.95) for i in range(10)] + [(f"b{i}", 1, 0.95 if i == 0 else 0.7) for i in range(6)]
    df = spark.createDataFrame(rows, "mac_address STRING, label INT, confidence DOUBLE")
    kept, used = TR.filter_confident(df, 0.9, 5)
    assert used == pytest.approx(0.7, abs=0.051) and kept.where("label = 1").count() == 6
    assert {r.label: r["count"] for r in TR.cap_imbalance(kept, 1.0).groupBy("label").count().collect()} == {0: 6, 1: 6}
    split = TR.stratified_split(df, 0.5).groupBy("label", "is_test").count().collect()
    assert {(r.label, r.is_test): r["count"] for r in split} == {(0, True): 5, (0, False): 5, (1, True): 3, (1, False): 3}


def test_neighbours_equal_brute_force(spark):
    pts = [(f"p{i:02d}", i % 3, ((i * 37) % 50) / 10, ((i * 91) % 70) / 10) for i in range(60)]
    df = spark.createDataFrame(pts, "mac_address STRING, label INT, x DOUBLE, y DOUBLE")
    got = {r.mac_address: r.prediction for r in knn_predict(df.where("mac_address < 'p40'"), df.where("mac_address >= 'p40'"), ["x", "y"], 5, group_rows=7).collect()}
    for n, _, x, y in pts[40:]:
        near = sorted((math.dist((x, y), (a, b)), m, lab) for m, lab, a, b in pts[:40])[:5]
        labels = [lab for _, _, lab in near]
        assert got[n] == min(set(labels), key=lambda c: (-labels.count(c), c))


def test_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "label INT, prediction INT")
    r = scores(df).first()
    assert (r.accuracy, r.balanced_accuracy, r.f1) == (0.75, 0.8333, 0.7667)


def test_forward_fill_over_block_borders(spark):
    df = spark.range(40).selectExpr("1 AS space_id", "id AS slot", "IF(id % 7 = 0, CAST(id AS DOUBLE), NULL) AS y")
    got = [r.y for r in TL.forward_fill(df, "y", "slot", 3, block=5).orderBy("slot").collect()]
    assert got == [float(i - i % 7) if i % 7 <= 3 else None for i in range(40)]


def test_sequences_over_block_borders(spark):
    df = spark.range(30).selectExpr("1 AS space_id", "timestampadd(HOUR, id, TIMESTAMP_NTZ '2024-01-01') AS ds", "CAST(id AS DOUBLE) AS y")
    rows = TL.sequences(df, 4, 3600, ["y"], block=6).orderBy("ds").collect()
    assert [(r.window, r.target) for r in rows] == [([[float(i - k)] for k in (4, 3, 2, 1)], float(i)) for i in range(4, 30)]


def test_a_failing_model_is_a_row_with_its_reason(spark):
    from roamlens.operators import classifiers as CL

    rows = [(f"d{i}", i % 2, float(i % 2) + i / 100, float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "mac_address STRING, label INT, a DOUBLE, b DOUBLE")

    def broken(train, test, cols):
        raise KeyError("no such column")

    names = ["LDA", "RidgeClassifier", "broken"]
    got = CL.train_bank(df, df, ["a", "b"], 2, names, extra={"broken": broken}).collect()
    assert [r.model for r in got] == ["LDA", "RidgeClassifier", "broken"]
    assert got[0].accuracy == 1.0 and got[0].failure is None
    assert got[2].accuracy is None and got[2].failure.startswith("KeyError")


def test_fitted_expressions(spark):
    from roamlens.operators import classifiers as CL

    rows = [(i % 3, float(i % 3) * 4 + (i % 7) / 7, float(i % 4)) for i in range(84)]
    df = spark.createDataFrame(rows, "label INT, a DOUBLE, b DOUBLE")
    for fit in (CL.fit_gaussian_nb, CL.fit_nearest_mean):
        assert df.select(fit(df, ["a", "b"]).alias("p"), "label").where("p <> label").count() == 0


def test_accelerated_model_is_a_fixed_point_and_starts_warm(spark):
    import random

    r = random.Random(2)
    votes = [[c if r.random() < 0.6 else r.choice([-1, 0, 1, 2]) for _ in range(5)] for c in (r.randrange(3) for _ in range(400))]
    pats = V.patterns(spark.createDataFrame([(v,) for v in votes], "votes ARRAY<INT>"))
    fast = LM.fit_converged(pats, 5, 3)
    slow = LM.fit_label_model(pats, 5, 3, epochs=2000, tolerance=1e-10)
    assert LM._moved(fast.log_p, slow.log_p) < 1e-6 and fast.iterations < slow.iterations
    step, _ = LM._em_step(pats, fast.log_p, 3)
    assert LM._moved(step, fast.log_p) < 1e-8
    more = V.patterns(spark.createDataFrame([(v,) for v in votes + votes[:40]], "votes ARRAY<INT>"))
    warm, cold = LM.fit_converged(more, 5, 3, start=fast), LM.fit_converged(more, 5, 3)
    assert LM._moved(warm.log_p, cold.log_p) < 1e-6 and warm.iterations <= cold.iterations


def test_pruned_search_is_exact_and_skips_blocks(spark):
    import random

    from roamlens.operators import neighbors as N

    r = random.Random(4)
    rows = []
    for i in range(600):
        c = r.randrange(8)
        rows.append((f"p{i:03d}", c % 3, 10.0 * c + r.gauss(0, 1), 5.0 * (c % 4) + r.gauss(0, 1)))
    rows += [(f"same{i:03d}", 1, 3.0, 3.0) for i in range(200)]  # one point a quarter of all rows share
    df = spark.createDataFrame(rows, "mac_address STRING, label INT, x DOUBLE, y DOUBLE")
    test = df.where("mac_address < 'p2' OR mac_address > 'same180'")
    for k in (1, 6):
        want = {q.mac_address: q.neighbours for q in N.nearest(df, test, ["x", "y"], k, group_rows=100).collect()}
        found, skipped = N.nearest_pruned(df, test, ["x", "y"], k, group_rows=25, pivots=30)
        assert {q.mac_address: q.neighbours for q in found.collect()} == want
        assert skipped > 0.5
    few = df.limit(3)
    found, _ = N.nearest_pruned(few, test.limit(4), ["x", "y"], 6, group_rows=2)
    assert all(len(q.neighbours) == 3 for q in found.collect())
    assert N.nearest_pruned(df.limit(0), test, ["x", "y"], 2)[0].collect() == []


def test_search_of_every_block_keeps_few_groups_and_ties(spark):
    import numpy as np
    import pandas as pd

    from roamlens.operators import neighbors as N

    assert N._dealt(90_000, 60) == N.MOST_BLOCKS  # not 1,500
    assert N._dealt(400, 60) == 7 and N._dealt(0, 60) == 1
    assert N._dealt(10**7, 60) == 500  # rows of a group stay bounded
    train = pd.DataFrame({"id": [f"{i:03}" for i in range(200)], "label": 0, "x": [np.array([float(i % 4)]) for i in range(200)]})
    test = pd.DataFrame({"id": ["q", "n"], "x": [np.array([1.2]), np.array([float("nan")])]})
    best = N._best_of_block(60)(train, test)
    by_hand = sorted((abs(i % 4 - 1.2), f"{i:03}") for i in range(200))[:60]
    got = best[best["id"] == "q"]
    assert list(got["other"]) == [i for _, i in by_hand] and np.allclose(got["dist"], [d for d, _ in by_hand])
    assert list(best[best["id"] == "n"]["other"]) == sorted(train["id"])[:60]


def test_pruned_search_works_on_slices_of_a_batch():
    import numpy as np
    import pyarrow as pa

    from roamlens.operators import neighbors as N

    batch = pa.record_batch({"x": [[float(i)] for i in range(1000)]})
    parts = list(N._slices(iter([batch, batch.slice(0, 0)]), N.TOGETHER // N.MOST_PIVOTS))
    assert max(b.num_rows for b in parts) == 256 and np.concatenate([N._points(b, "x") for b in parts]).ravel().tolist() == list(map(float, range(1000)))


def test_an_iteration_is_one_stage(spark):
    pats = V.patterns(spark.createDataFrame([([c % 3, (c * 7) % 4 - 1, -1],) for c in range(60)], "votes ARRAY<INT>"))
    stored = LM._stored(pats)
    stages = set()
    sc = spark.sparkContext
    sc.setJobGroup("em", "em")
    model, reached = LM._em_step(stored, LM._initial(3, 3), 3)
    for job in sc.statusTracker().getJobIdsForGroup("em"):
        stages |= set(sc.statusTracker().getJobInfo(job).stageIds)
    sc.setLocalProperty("spark.jobGroup.id", None)
    tasks = [sc.statusTracker().getStageInfo(s) for s in stages]
    assert sum(t.numTasks for t in tasks if t and t.numCompletedTasks) == 1
    both = LM._em_steps(stored, [model, LM._initial(3, 3)], 3)
    assert LM._moved(both[1][0], model) < 1e-12 and both[0][1] > both[1][1] and abs(both[1][1] - reached) < 1e-9
