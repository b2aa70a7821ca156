"""A bank of classifiers over weak labels.

MLlib estimators where Spark has the algorithm; discriminant analysis and
ridge from aggregated moments; exact neighbours by blocks; boosting as a loop
over weighted MLlib stumps. Two entries are stand-ins and say so by name.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from roamlens.operators.evaluation import scores
from roamlens.operators.neighbors import knn_predict
from roamlens.operators.scope import KEY
from roamlens.session import durable

log = logging.getLogger(__name__)
SCORES = "model STRING, accuracy DOUBLE, balanced_accuracy DOUBLE, f1 DOUBLE, failure STRING"


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def class_moments(train: DataFrame, cols: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Classes, their sizes, sums and sums of products, from one aggregate."""
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = train.groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(c) for c in cols]).alias("s"),
        F.array(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).alias("p"),
    ).orderBy("label").collect()  # one row per class
    products = np.zeros((len(rows), d, d))
    for r, row in enumerate(rows):
        for (i, j), v in zip(pairs, row["p"]):
            products[r, i, j] = products[r, j, i] = v
    return (
        [int(r["label"]) for r in rows], np.array([float(r["n"]) for r in rows]),
        np.array([r["s"] for r in rows], dtype=float).reshape(len(rows), d), products,
    )


def class_means(train: DataFrame, cols: list[str]) -> DataFrame:
    return train.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])


def _linear_argmax(cols: list[str], classes: list[int], w: np.ndarray, b: np.ndarray) -> Column:
    """Class with the largest linear score, the first on a tie."""
    scored = []
    for c in range(len(classes)):
        s = F.lit(float(b[c]))
        for i, name in enumerate(cols):
            s = s + F.col(name) * F.lit(float(w[c][i]))
        scored.append(s)
    s = F.array(*scored)
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(s, F.array_max(s)).cast("int"))


def fit_lda(train: DataFrame, cols: list[str]) -> Column:
    """Linear discriminant analysis: class means, pooled covariance."""
    classes, n, s, p = class_moments(train, cols)
    means = s / n[:, None]
    within = sum(p[c] - n[c] * np.outer(means[c], means[c]) for c in range(len(classes)))
    inv = np.linalg.pinv(within / max(n.sum() - len(classes), 1.0))
    w = means @ inv
    b = np.array([-0.5 * means[c] @ inv @ means[c] + math.log(n[c] / n.sum()) for c in range(len(classes))])
    return _linear_argmax(cols, classes, w, b)


def fit_ridge(train: DataFrame, cols: list[str], alpha: float = 1.0) -> Column:
    """Ridge regression on +1/-1 targets per class, from normal equations."""
    classes, n, s, p = class_moments(train, cols)
    total, sums = n.sum(), s.sum(axis=0)
    mean = sums / total
    gram = p.sum(axis=0) - total * np.outer(mean, mean) + alpha * np.eye(len(cols))
    w, b = [], []
    for c in range(len(classes)):
        y_mean = (2 * n[c] - total) / total
        xy = 2 * s[c] - sums - total * mean * y_mean
        coef = np.linalg.solve(gram, xy)
        w.append(coef)
        b.append(y_mean - mean @ coef)
    return _linear_argmax(cols, classes, np.array(w), np.array(b))


def fit_adaboost(train: DataFrame, k: int, rounds: int, key: str = KEY) -> list[tuple[float, object]]:
    """SAMME over depth-1 trees; [(weight, tree)]. Weights live in a column
    whose lineage is cut every few rounds."""
    df = train.select(key, "label", "features", F.lit(1.0).alias("w"))
    stages = []
    for r in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=1, weightCol="w", predictionCol="_p").fit(df)
        wrong = (F.col("_p") != F.col("label")).cast("double")
        hit = tree.transform(df).select(key, "label", "features", "w", wrong.alias("_wrong"))
        sums = hit.agg(F.sum("w").alias("all"), F.sum(F.col("w") * F.col("_wrong")).alias("bad")).first()
        err = sums["bad"] / sums["all"]
        if err >= 1.0 - 1.0 / k:
            break
        alpha = math.log((1.0 - err) / max(err, 1e-10)) + math.log(max(k - 1, 1))
        stages.append((alpha, tree))
        if err <= 0.0:
            break
        df = hit.select(key, "label", "features", (F.col("w") * F.exp(F.lit(alpha) * F.col("_wrong")) / F.lit(sums["all"])).alias("w"))
        if r % 5 == 4:
            df = durable(df)
    return stages


def adaboost_predict(test: DataFrame, stages: list[tuple[float, object]], k: int) -> DataFrame:
    keep = test.columns
    for i, (_, tree) in enumerate(stages):
        tree = tree.copy()
        tree.setPredictionCol(f"_p{i}").setRawPredictionCol("").setProbabilityCol("")
        test = tree.transform(test)
    votes = [
        sum((F.when(F.col(f"_p{i}") == c, F.lit(a)).otherwise(0.0) for i, (a, _) in enumerate(stages)), F.lit(0.0))
        for c in range(k)
    ]
    s = F.array(*votes)
    return test.select(*keep, (F.array_position(s, F.array_max(s)).cast("int") - 1).alias("prediction"))


def bank(k: int, max_depth: int = 5, n_estimators: int = 100, seed: int = 42, key: str = KEY) -> dict[str, Callable]:
    """name -> fit_predict(train, test, cols) giving (key, label, prediction).

    Labels are class indexes 0..k-1; columns are scaled.
    """

    def ml(estimator, penalised: bool = False) -> Callable:
        def run(train, test, cols):
            est = estimator
            if penalised:  # unit penalty on the summed loss, as mean loss
                est = est(1.0 / max(train.count(), 1))
            return est.fit(assemble(train, cols)).transform(assemble(test, cols)).select(
                key, "label", F.col("prediction").cast("int").alias("prediction")
            )

        return run

    def linear(fit) -> Callable:
        return lambda train, test, cols: test.select(key, "label", fit(train, cols).alias("prediction"))

    def ada(train, test, cols):
        stages = fit_adaboost(assemble(train, cols), k, min(n_estimators, 50), key)
        return adaboost_predict(assemble(test, cols), stages, k).select(key, "label", "prediction")

    def knn(train, test, cols):
        return test.select(key, "label").join(knn_predict(train, test, cols, 5, key), key)

    depth = max_depth or 5
    return {
        "LogisticRegression": ml(lambda reg: LogisticRegression(maxIter=1000, regParam=reg), True),
        "RidgeClassifier": linear(fit_ridge),
        "SGDClassifier (LinearSVC, few steps)": ml(OneVsRest(classifier=LinearSVC(maxIter=10, regParam=1e-4), parallelism=k)),
        "DecisionTree": ml(DecisionTreeClassifier(maxDepth=depth, seed=seed)),
        "RandomForest": ml(RandomForestClassifier(numTrees=n_estimators, maxDepth=depth, seed=seed)),
        "ExtraTrees (RandomForest, no bootstrap)": ml(
            RandomForestClassifier(numTrees=n_estimators, maxDepth=depth, seed=seed, bootstrap=False, maxBins=8, featureSubsetStrategy="sqrt")
        ),
        "GradientBoosting": ml(OneVsRest(classifier=GBTClassifier(maxIter=n_estimators, maxDepth=max_depth or 3, seed=seed), parallelism=k)),
        "AdaBoost": ada,
        "KNeighbors": knn,
        "LinearSVC": ml(lambda reg: OneVsRest(classifier=LinearSVC(maxIter=2000, regParam=reg), parallelism=k), True),
        "GaussianNB": ml(NaiveBayes(modelType="gaussian")),
        "LDA": linear(fit_lda),
    }


def train_bank(
    train: DataFrame, test: DataFrame, cols: list[str], k: int, models: list[str] | None = None,
    max_depth: int = 5, n_estimators: int = 100, seed: int = 42, key: str = KEY, at_once: int = 4,
    extra: dict[str, Callable] | None = None,
) -> DataFrame:
    """(model, accuracy, balanced_accuracy, f1, failure), best accuracy first.

    A model that fails is a row without scores and with the reason. ``at_once``
    models are trained side by side, each as Spark jobs of its own; ``extra`` adds
    further ones to the bank.
    """
    train, test = train.persist(), test.persist()
    work = {n: f for n, f in (bank(k, max_depth, n_estimators, seed, key) | (extra or {})).items() if models is None or n in models}

    def run(name: str) -> DataFrame:
        try:
            row = scores(work[name](train, test, cols)).select(F.lit(name).alias("model"), "*", F.lit(None).cast("string").alias("failure"))
            return durable(row)
        except Exception as e:
            log.warning("%s failed: %s", name, e)
            reason = f"{type(e).__name__}: {e}".splitlines()[0][:200]
            return train.sparkSession.createDataFrame([(name, None, None, None, reason)], SCORES)

    try:
        with ThreadPoolExecutor(at_once) as pool:
            rows = list(pool.map(run, work))
    finally:
        train.unpersist()
        test.unpersist()
    if not rows:
        raise ValueError("no model asked for")
    return reduce(DataFrame.unionByName, rows).orderBy(F.col("accuracy").desc_nulls_last(), "model")


def fit_gaussian_nb(train: DataFrame, cols: list[str], smoothing: float = 1e-9) -> Column:
    """Gaussian naive Bayes as one expression of the columns: class shares, means and
    variances from one aggregate, the variances raised by ``smoothing`` times the
    largest variance of a column over all classes."""
    rows = train.groupBy("label").agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("m"), F.array(*[F.var_pop(c) for c in cols]).alias("v")
    ).orderBy("label").collect()  # one row per class
    extra = smoothing * max(train.agg(*[F.var_pop(c) for c in cols]).first())
    total = sum(r["n"] for r in rows)
    scored = []
    for r in rows:
        s = F.lit(math.log(r["n"] / total))
        for c, m, v in zip(cols, r["m"], r["v"]):
            s = s - 0.5 * (F.lit(math.log(2 * math.pi * (v + extra))) + (F.col(c) - m) * (F.col(c) - m) / (v + extra))
        scored.append(s)
    s = F.array(*scored)
    return F.element_at(F.array(*[F.lit(int(r["label"])) for r in rows]), F.array_position(s, F.array_max(s)).cast("int"))


def fit_nearest_mean(train: DataFrame, cols: list[str]) -> Column:
    """The class whose mean is nearest, the smaller one on a tie; one expression of the columns."""
    rows = class_means(train, cols).collect()  # one row per class
    options = []
    for r in rows:
        square = sum(((F.col(c) - F.lit(r[c])) * (F.col(c) - F.lit(r[c])) for c in cols), F.lit(0.0))
        options.append(F.struct(square.alias("d"), F.lit(int(r["label"])).alias("c")))
    return F.array_min(F.array(*options))["c"]
