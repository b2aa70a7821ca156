"""Least squares by merged factors and rolled-out forecasts against numpy."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from roamlens.operators import forecasting as H, least_squares as Q, timeline as L


def designs(seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for space, n, width in ((1, 400, 6), (2, 3, 6), (3, 40, 6), (None, 9, 6)):
        x = r.normal(size=(n, width))
        x[:, 0] = 1.0
        if space == 3:
            x[:, 2] = x[:, 1]  # no unique solution
        y = x @ r.normal(size=width) + r.normal(size=n)
        rows += [(space, [float(v) for v in a], float(b)) for a, b in zip(x, y)]
    return rows


@pytest.mark.parametrize("ridge", [0.0, 2.5])
def test_merged_factors_equal_numpy(spark, monkeypatch, ridge):
    for name, value in (("STACK", 7), ("OPEN", 2), ("MERGED", 2)):
        monkeypatch.setattr(Q, name, value)
    rows = designs()
    df = spark.createDataFrame(rows + [(1, [9.0] * 6, None)], "space_id INT, x ARRAY<DOUBLE>, y DOUBLE").repartition(5)
    got = {r.space_id: r for r in Q.least_squares(df, "space_id", ridge, free=1).collect()}
    assert set(got) == {1, 2, 3}  # a series without a name is none
    for space, found in got.items():
        x = np.array([a for s, a, _ in rows if s == space])
        y = np.array([b for s, _, b in rows if s == space])
        penalty = np.sqrt(ridge) * np.eye(6)[1:]
        want = np.linalg.lstsq(np.vstack([x, penalty]), np.r_[y, np.zeros(5)], rcond=None)[0]
        assert found.n == len(y) and np.allclose(found.coef, want, atol=1e-8)


def test_no_rows_give_no_fit(spark):
    df = spark.createDataFrame([], "space_id INT, x ARRAY<DOUBLE>, y DOUBLE")
    assert Q.least_squares(df, "space_id").collect() == []


def test_gradients_vanish_at_the_fit_only(spark):
    rows = [r for r in designs(3) if r[0] in (1, 2)]
    df = spark.createDataFrame(rows, "space_id INT, x ARRAY<DOUBLE>, y DOUBLE")
    coefs = Q.least_squares(df, "space_id", 1.0, free=1)
    worst = H.gradients(df, coefs).agg(F.max(F.abs("gradient"))).first()[0]
    assert worst < 1e-9
    off = coefs.withColumn("coef", F.transform("coef", lambda c: c + 0.1))
    assert H.gradients(df, off).agg(F.max(F.abs("gradient"))).first()[0] > 1


START = datetime(2024, 1, 1)


def series(spark, n=60):
    r = np.random.default_rng(2)
    rows = []
    for space in (1, 2):
        y = [5.0, 6.0, 4.0]
        for _ in range(n):
            y.append(max(0.0, 2 + 0.5 * y[-1] - 0.2 * y[-2] + 0.3 * y[-3] + float(r.normal())))
        rows += [(space, START + timedelta(hours=h), v) for h, v in enumerate(y)]
    rows.append((3, START, 1.0))  # too short for any lag
    return spark.createDataFrame(rows, "space_id INT, ds TIMESTAMP_NTZ, y DOUBLE"), rows


def test_rollout_feeds_predictions_back(spark):
    df, rows = series(spark)
    windows = L.sequences(df, 3, 3600)
    coefs = Q.least_squares(H.lagged(windows), "space_id")
    got = {(r.space_id, r.step): (r.ds, r.yhat) for r in H.rollout(df, coefs, 30, 3600).collect()}
    assert len(got) == 60
    for r in coefs.collect():
        past = [y for s, _, y in rows if s == r.space_id]
        last = START + timedelta(hours=len(past) - 1)
        for step in range(1, 31):
            past.append(max(0.0, r.coef[0] + sum(w * v for w, v in zip(r.coef[1:], past[-3:]))))
            ds, yhat = got[r.space_id, step]
            assert ds == last + timedelta(hours=step) and abs(yhat - past[-1]) < 1e-9


def test_rollout_of_a_fitted_model_in_rounds(spark):
    df, _ = series(spark)
    windows = L.sequences(df, 3, 3600)
    model = H.fit_autoregressive(windows)
    newest = df.join(df.groupBy("space_id").agg(F.max("ds").alias("_hi")), "space_id").where("ds > _hi - INTERVAL 3 HOURS AND space_id < 3")
    start = newest.groupBy("space_id").agg(
        F.max("ds").alias("ds"), F.transform(F.array_sort(F.collect_list(F.struct("ds", "y"))), lambda r: F.array(r["y"])).alias("window")
    )
    got = sorted(tuple(r) for r in H.rollout_model(start, model, 4, 3600).select("space_id", "step", "yhat").collect())
    for space in (1, 2):
        past = [r[0] for r in start.where(F.col("space_id") == space).first()["window"]]
        for step in range(1, 5):
            past.append(max(0.0, model.intercept + float(np.dot(model.coefficients.toArray(), past[-3:]))))
            assert abs(got[(space - 1) * 4 + step - 1][2] - past[-1]) < 1e-9
