"""Seasonal and autoregressive forecasts per space, and their errors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from roamlens.functions.times import slot, slot_start
from roamlens.operators.least_squares import least_squares
from roamlens.session import durable


def fit_seasonal(train: DataFrame, ridge: float = 1.0) -> DataFrame:
    """(space_id, n, coef) of a ridge regression per space on the design column
    ``x``, whose first entry, the intercept, bears no penalty."""
    return least_squares(train, "space_id", ridge, free=1)


def gradients(design: DataFrame, coefs: DataFrame, ridge: float = 1.0, free: int = 1) -> DataFrame:
    """(space_id, column, gradient, size): the derivative of the squared error by each
    coefficient, zero at the fit, and the sum of the sizes of its terms."""
    dot = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    terms = design.join(coefs.select("space_id", "coef"), "space_id").select(
        "space_id", F.posexplode(F.zip_with("x", "coef", lambda a, c: F.struct(a.alias("a"), c.alias("c")))).alias("column", "t"),
        (F.col("y") - dot).alias("_e"),
    )
    term = F.col("t.a") * F.col("_e")
    sums = terms.groupBy("space_id", "column").agg(F.sum(term).alias("g"), F.sum(F.abs(term)).alias("size"), F.first("t.c").alias("c"))
    penalty = F.when(F.col("column") >= free, F.lit(ridge) * F.col("c")).otherwise(0.0)
    return sums.select("space_id", "column", (F.col("g") - penalty).alias("gradient"), (F.col("size") + F.abs(penalty)).alias("size"))


def predict_seasonal(design: DataFrame, coefs: DataFrame) -> DataFrame:
    """Adds ``yhat``, never below 0; a JVM-side dot product."""
    dot = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    return design.join(coefs.select("space_id", "coef"), "space_id").withColumn(
        "yhat", F.greatest(dot, F.lit(0.0))
    ).drop("coef")


def lagged(windows: DataFrame) -> DataFrame:
    """Design of a linear recursion: ``x`` = 1 and the past values, oldest first; ``y`` the target."""
    past = F.transform("window", lambda r: r[0])
    return windows.select("space_id", "ds", F.concat(F.array(F.lit(1.0)), past).alias("x"), F.col("target").alias("y"))


def rollout(known: DataFrame, coefs: DataFrame, steps: int, interval_s: int) -> DataFrame:
    """(space_id, ds, step, yhat): the next ``steps`` values of each space.

    ``coefs`` are those of ``lagged`` rows (intercept, then k weights, oldest first).
    Each prediction, never below 0, is the newest past value of the next one. A
    space is one row: its last k values and the walk over the steps. Spaces with
    fewer known values than lags are left out.
    """
    lags = coefs.select("space_id", "coef", (F.size("coef") - 1).alias("_k"))
    most = lags.agg(F.max("_k")).first()[0] or 0
    number = slot("ds", interval_s)
    last = known.groupBy("space_id").agg(F.max(number).alias("_last"))
    recent = known.select("space_id", number.alias("_slot"), F.col("y").cast("double").alias("y")).join(last, "space_id").where(
        F.col("_slot") > F.col("_last") - most
    )
    past = recent.groupBy("space_id", "_last").agg(F.array_sort(F.collect_list(F.struct("_slot", "y")))["y"].alias("_past"))
    start = past.join(lags, "space_id").where(F.size("_past") >= F.col("_k")).withColumn("_past", F.slice("_past", -F.greatest("_k", F.lit(1)), F.greatest("_k", F.lit(1))))

    def step(state, _):
        weighted = F.zip_with(F.slice("coef", F.lit(2), F.col("_k")), state["past"], lambda w, v: w * v)
        new = F.greatest(F.aggregate(weighted, F.element_at("coef", 1), lambda t, v: t + v), F.lit(0.0))
        return F.struct(
            F.concat(F.slice(state["past"], 2, F.size(state["past"])), F.array(new)).alias("past"),
            F.concat(state["out"], F.array(new)).alias("out"),
        )

    none = F.array().cast("array<double>")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.col("_past").alias("past"), none.alias("out")), step)["out"]
    return start.select("space_id", "_last", F.posexplode(walked).alias("_p", "yhat")).select(
        "space_id", slot_start(F.col("_last") + F.col("_p") + 1, interval_s).alias("ds"), (F.col("_p") + 1).alias("step"), "yhat"
    )


def rollout_model(windows: DataFrame, model, steps: int, interval_s: int, features=None) -> DataFrame:
    """The same in rounds with any fitted model: (space_id, ds, step, yhat).

    ``windows`` holds the newest window of each space (window, ds of the last row in
    it); ``features`` gives the columns of a row that follow y from its ds. Each
    round predicts all spaces at once, drops their oldest row and appends the new one.
    """
    features = features or (lambda ds: [])
    at, out = windows.select("space_id", "ds", "window"), None
    for k in range(1, steps + 1):
        ahead = at.withColumn("ds", F.timestamp_add("SECOND", F.lit(interval_s).cast("long"), F.col("ds")))
        found = predict_autoregressive(ahead, model).withColumn("yhat", F.greatest("yhat", F.lit(0.0)))
        row = F.array(F.col("yhat"), *features("ds"))
        # every round is stored: later ones start from its rows
        found = durable(found.select("space_id", "ds", "yhat", F.concat(F.slice("window", F.lit(2), F.size("window") - 1), F.array(row)).alias("window")))
        part = found.select("space_id", "ds", F.lit(k).alias("step"), "yhat")
        out = part if out is None else out.unionByName(part)
        at = found.select("space_id", "ds", "window")
    return out


def flat_windows(windows: DataFrame) -> DataFrame:
    """``features`` vector of a window's rows, oldest first."""
    return windows.withColumn("features", array_to_vector(F.flatten("window")))


def fit_autoregressive(windows: DataFrame, learner: str = "linear"):
    """One model over the windows of all spaces: 'linear' or 'gbt'."""
    data = flat_windows(windows)
    if learner == "linear":
        est = LinearRegression(featuresCol="features", labelCol="target", predictionCol="yhat", regParam=1e-3)
    else:
        est = GBTRegressor(featuresCol="features", labelCol="target", predictionCol="yhat", maxIter=20)
    return est.fit(data)


def predict_autoregressive(windows: DataFrame, model) -> DataFrame:
    return model.transform(flat_windows(windows)).drop("features")


def errors(df: DataFrame, actual: str = "y", predicted: str = "yhat", keys=()) -> DataFrame:
    """RMSE, MAE and size of a prediction table."""
    e = F.col(predicted) - F.col(actual)
    aggs = [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("test_size")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
