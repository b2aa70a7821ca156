"""From class probabilities to a balanced, split and scaled training table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from roamlens.operators.label_model import argmax
from roamlens.operators.ordered import blocked_row_number
from roamlens.operators.scope import KEY

ENTROPY_EPS = 1e-10


def confidence(probs: Column | str, method: str = "max_confidence", k: int | None = None) -> Column:
    """Largest probability, or one minus the normalised entropy."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    if method == "max_confidence":
        return F.array_max(probs)
    terms = F.transform(probs, lambda p: p * F.log(p + F.lit(ENTROPY_EPS)))
    classes = F.size(probs).cast("double") if k is None else F.lit(float(k))
    return F.lit(1.0) + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.log(classes)


def scored(preds: DataFrame, method: str = "max_confidence", key: str = KEY) -> DataFrame:
    """(key, label, confidence) from probabilities, or from hard labels at 1.0."""
    if "probs" in preds.columns:
        return preds.select(key, argmax("probs").alias("label"), confidence("probs", method).alias("confidence"))
    return preds.select(key, "label", F.lit(1.0).alias("confidence"))


def threshold_steps(threshold: float) -> list[float]:
    steps = [threshold]
    while steps[-1] > 0.1:
        steps.append(steps[-1] - 0.05)
    return steps


def filter_confident(labels: DataFrame, threshold: float = 0.8, min_per_class: int = 10) -> tuple[DataFrame, float]:
    """Labels at or above the threshold, and the threshold that was used.

    While a class that is present has too few rows the threshold goes down by
    0.05; all steps are counted in one aggregate (classes x steps numbers).
    """
    steps = threshold_steps(threshold)
    labels = labels.where("label <> -1")
    counts = labels.groupBy("label").agg(
        *[F.count_if(F.col("confidence") >= F.lit(t)).alias(f"t{i}") for i, t in enumerate(steps)]
    ).collect()
    used = steps[-1]
    for i, t in enumerate(steps):
        if all(r[f"t{i}"] >= min_per_class for r in counts if r[f"t{i}"] > 0):
            used = t
            break
    return labels.where(F.col("confidence") >= F.lit(used)), used


def draw(key: str, seed: int) -> Column:
    """A fixed pseudo-random hex text per entity."""
    return F.md5(F.concat_ws("#", F.col(key), F.lit(str(seed))))


def _ranked(labels: DataFrame, key: str, seed: int) -> DataFrame:
    """Random rank of each row within its class. A class may hold most of the
    rows, so it is ranked in 4096 hash blocks with carried offsets."""
    d = labels.withColumn("_h", draw(key, seed))
    block = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    return blocked_row_number(d, ["label"], ["_h", key], block, "_rank").drop("_h")


def cap_imbalance(labels: DataFrame, factor: float = 3.0, seed: int = 42, key: str = KEY) -> DataFrame:
    """At most int(factor * smallest class) random rows of each class."""
    sizes = labels.groupBy("label").count().collect()  # one row per class
    if not sizes:
        return labels
    cap = int(factor * min(r["count"] for r in sizes))
    if all(r["count"] <= cap for r in sizes):
        return labels
    return _ranked(labels, key, seed).where(F.col("_rank") <= cap).drop("_rank")


def stratified_split(labels: DataFrame, test: float = 0.2, seed: int = 42, key: str = KEY) -> DataFrame:
    """Adds ``is_test``: the first round(n * test) random rows of each class."""
    sizes = labels.groupBy("label").agg(F.floor(F.count("*") * F.lit(test) + F.lit(0.5)).alias("_n"))
    return (
        _ranked(labels, key, seed).join(sizes, "label")
        .withColumn("is_test", F.col("_rank") <= F.col("_n")).drop("_rank", "_n")
    )


def filtering_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: sizes, mean confidence and retention of the filter."""
    b = before.agg(F.count("*").alias("samples_before_filter"), F.avg("confidence").alias("b"), F.lit(1).alias("_j"))
    a = after.agg(F.count("*").alias("samples_after_filter"), F.avg("confidence").alias("a"), F.lit(1).alias("_j"))
    return b.join(a, "_j").select(
        "samples_before_filter", "samples_after_filter",
        F.round("b", 4).alias("confidence_before_filter"),
        F.round(F.coalesce("a", F.lit(0.0)), 4).alias("confidence_after_filter"),
        F.round(
            F.coalesce(F.try_divide(F.col("samples_after_filter"), F.col("samples_before_filter")), F.lit(0.0)), 4
        ).alias("filter_retention_rate"),
    )


def merge_features(base: DataFrame, features: list[DataFrame], key: str = KEY) -> DataFrame:
    """Left joins of feature tables; a repeated column gets ``_feat<i>``."""

    def step(acc: DataFrame, item: tuple[int, DataFrame]) -> DataFrame:
        i, f = item
        clash = {c: f"{c}_feat{i}" for c in f.columns if c != key and c in acc.columns}
        return acc.join(f.withColumnsRenamed(clash), key, "left")

    return reduce(step, enumerate(features), base)


def training_frame(labels: DataFrame, features: list[DataFrame], key: str = KEY) -> tuple[DataFrame, list[str]]:
    """Labels with numeric feature columns (all-NULL ones dropped, gaps 0)."""
    df = merge_features(labels, features, key)
    skip = {key, *labels.columns}
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    if not numeric:
        raise ValueError("no numeric feature column")
    seen = df.agg(*[F.count(c).alias(c) for c in numeric]).first()
    kept = [c for c in numeric if seen[c] > 0]
    return df.select(
        *labels.columns, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in kept]
    ), kept


def scaler_stats(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column (2 numbers each)."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in cols}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std with the numbers fitted on the training rows."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


