"""Column profiles of a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T



TOP_SALTS = 64


def _numeric(df: DataFrame) -> tuple[list[str], list[str]]:
    num = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return num, [c for c in df.columns if c not in num]


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: dtype, null_count; min/max/mean/std of numbers,
    unique_count of the rest. Numbers take one aggregate row for all columns;
    the rest is one count per (column, value)."""
    num, other = _numeric(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    parts = []
    if num:
        aggs = []
        for c in num:
            v = F.col(c).cast("double")
            aggs.append(
                F.struct(
                    F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                    F.count_if(F.col(c).isNull()).alias("null_count"),
                    F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 4).alias("mean"),
                    F.round(F.stddev_samp(v), 4).alias("std"), F.lit(None).cast("bigint").alias("unique_count"),
                )
            )
        parts.append(df.agg(F.array(*aggs).alias("a")).select(F.inline("a")))
    if other:
        counts = value_counts(df)
        names = df.sparkSession.createDataFrame([(c, types[c]) for c in other], "column_name STRING, dtype STRING")
        none = F.lit(None).cast("double")
        parts.append(
            names.join(
                counts.groupBy("column_name").agg(
                    F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
                    F.count("value").alias("unique_count"),
                ),
                "column_name", "left",
            ).select(
                "column_name", "dtype", F.coalesce("null_count", F.lit(0)).alias("null_count"),
                none.alias("min"), none.alias("max"), none.alias("mean"), none.alias("std"),
                F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_counts(df: DataFrame) -> DataFrame:
    """(column_name, value, n) of the non-numeric columns."""
    _, other = _numeric(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in other])
    return df.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each non-numeric column (ties by value).

    Ranked in salted parts first, so a column of many values is not sorted in
    one task.
    """
    counts = value_counts(df).where("value IS NOT NULL")
    order = [F.col("n").desc(), F.col("value").asc()]
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(TOP_SALTS)))
    part = Window.partitionBy("column_name", "_salt").orderBy(*order)
    full = Window.partitionBy("column_name").orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
        .withColumn("rank", F.row_number().over(full)).where(F.col("rank") <= k)
        .select("column_name", "rank", "value", "n")
    )
