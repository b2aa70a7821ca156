"""Order-dependent steps whose groups stay small.

A plain window over (key) puts a key's whole history into one task. These
helpers cut each key into blocks, do the ordered work inside (key, block),
and carry one summary row per block across block borders, so a hot key is
spread over many tasks and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roamlens.functions.times import col


def blocked_row_number(df: DataFrame, keys: list[str], order: list, block: Column, out: str = "rn") -> DataFrame:
    """row_number() per key; ``block`` must be non-decreasing in ``order``."""
    d = df.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        d.withColumn("_pos", F.row_number().over(inner))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_pos") + F.col("_offset"))
        .drop("_pos", "_offset", "_block")
    )


def running_max(df: DataFrame, keys: list[str], order: list, value: str, block: Column, out: str) -> DataFrame:
    """Maximum of ``value`` over all earlier rows of the key (NULL on the first)."""
    d = df.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        d.groupBy(*keys, "_block").agg(F.max(value).alias("_m"))
        .withColumn("_carry", F.max("_m").over(before))
        .drop("_m")
    )
    inner = (
        Window.partitionBy(*keys, "_block").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        d.withColumn("_in", F.max(value).over(inner))
        .join(carried, [*keys, "_block"])
        .withColumn(out, F.greatest("_in", "_carry"))
        .drop("_in", "_carry", "_block")
    )


def with_halo(df: DataFrame, number: Column | str, back: int, block: int) -> DataFrame:
    """Copy rows into each block that needs them to look ``back`` slots back.

    Adds ``_block`` and ``_home`` (true in the block a row belongs to). After a
    window over (key, _block), keep the home rows.
    """
    n = col(number)
    first = F.floor(n / F.lit(block)).cast("long")
    last = F.floor((n + F.lit(back)) / F.lit(block)).cast("long")
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_home", F.col("_block") == first
    )


def top_one(df: DataFrame, keys: list[str], best: Column, name: str, keep: list[str] = ()) -> DataFrame:
    """Row with the largest ``best`` per key, smallest ``name`` on a tie.

    An aggregate (with map-side combine), not a sort of each key.
    """
    # (-best, name) minimal
    winner = F.min(F.struct((-best).alias("_b"), F.col(name), *[F.col(k) for k in keep]))
    return df.groupBy(*keys).agg(winner.alias("_w")).select(
        *keys, F.col(f"_w.{name}").alias(name), *[F.col(f"_w.{k}").alias(k) for k in keep]
    )
