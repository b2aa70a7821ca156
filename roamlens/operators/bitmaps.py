"""Exact distinct counts by bitmaps over dense device numbers.

A device becomes one bit; the devices of a (space, bin) become bitmaps of 32,768
numbers each, built on the map side. Counts of larger groups are ORs of bitmaps:
no row of a device is copied or shuffled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roamlens.functions.times import slot_start
from roamlens.operators.bins import explode_bins
from roamlens.operators.tree import closure

# Blocks that the devices of one home space are numbered in.
BLOCKS = 64


def dense_numbers(s: DataFrame, key: str = "mac_address", home: str = "space_id", blocks: int = BLOCKS) -> DataFrame:
    """(key, number): 0, 1, 2 … without gaps, devices with one home next to each other.

    The home is the smallest space a device was seen at, so devices that meet share
    bitmaps. Devices are numbered inside (home, hash block); blocks, of which there
    are few, are added up in one short window. Rows without a key have no number.
    """
    devices = s.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(home).alias("_home"))
    placed = devices.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    sizes = placed.groupBy("_home", "_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.col("_home").asc_nulls_first(), "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_home", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = placed.withColumn("_row", F.row_number().over(Window.partitionBy("_home", "_block").orderBy(key)))
    same = inside["_home"].eqNullSafe(offsets["_home"]) & (inside["_block"] == offsets["_block"])
    return inside.join(offsets, same).select(key, (F.col("_offset") + F.col("_row") - 1).alias("number"))


def device_bitmaps(seen: DataFrame, numbers: DataFrame, by: list[str], key: str = "mac_address") -> DataFrame:
    """(by…, bucket, devices): bitmaps of the devices of each group."""
    return (
        seen.join(numbers, key).groupBy(*by, F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("devices"))
    )


def distinct_rollup_bitmaps(s: DataFrame, tree: DataFrame, interval_s: int, start=None, end=None) -> DataFrame:
    """Distinct devices per (subtree, bin) as in ``distinct_rollup``, bitmaps instead of device rows above the rooms."""
    seen = explode_bins(s.select("space_id", "mac_address", "start_time", "end_time"), interval_s, start, end)
    own = device_bitmaps(seen.select("space_id", "slot", "mac_address"), dense_numbers(s), ["space_id", "slot"])
    up = closure(tree).select(F.col("descendant").alias("space_id"), "ancestor")
    merged = own.join(up, "space_id").groupBy("ancestor", "slot", "bucket").agg(F.bitmap_or_agg("devices").alias("devices"))
    return (
        merged.groupBy("ancestor", "slot").agg(F.sum(F.bitmap_count("devices")).alias("number_connections"))
        .select(F.col("ancestor").alias("space_id"), slot_start("slot", interval_s).alias("interval_begin_time"), "number_connections")
    )


def distinct_by(df: DataFrame, by: list[str], numbers: DataFrame, key: str = "mac_address") -> DataFrame:
    """(by…, n): exact COUNT(DISTINCT key) per group, bitmaps built before the shuffle."""
    bitmaps = device_bitmaps(df.select(*by, key), numbers, by, key)
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("devices")).alias("n"))
