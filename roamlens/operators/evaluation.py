"""Classifier scores from a confusion table, and batch scoring."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def confusion(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return preds.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count("*").alias("n"))


def scores(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, balanced accuracy (mean recall), weighted F1."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), zero.alias("guessed"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("c"), zero.alias("actual"), F.col("n").alias("guessed"), zero.alias("tp")),
    )
    per_class = (
        confusion(preds, label, prediction).select(F.inline(sides)).groupBy("c")
        .agg(F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("tp").alias("tp"))
    )
    recall = F.try_divide(F.col("tp").cast("double"), F.col("actual").cast("double"))
    f1 = F.col("tp") * F.lit(2.0) / (F.col("actual") + F.col("guessed"))
    total = F.sum("actual")
    return per_class.agg(
        F.round(F.sum("tp") / total, 4).alias("accuracy"),
        F.round(F.avg(recall), 4).alias("balanced_accuracy"),
        F.round(F.sum(f1 * F.col("actual")) / total, 4).alias("f1"),
    )


def batch_score(df: DataFrame, model) -> DataFrame:
    """A stored table with a ``prediction`` column from a fitted MLlib model."""
    return model.transform(df).select(*df.columns, "prediction")


def batch_score_python(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], columns: list[str], returns: str = "double") -> DataFrame:
    """The same with a Python model, called on Arrow batches."""

    @F.pandas_udf(returns)
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(predict(rows))

    return df.withColumn("prediction", run(F.struct(*columns)))
