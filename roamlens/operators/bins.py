"""Occupancy bins: exact distinct devices per (space, time bin)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roamlens.functions.times import check_interval, slot, slot_before, slot_start, ts


def explode_bins(s: DataFrame, interval_s: int, start=None, end=None) -> DataFrame:
    """One row per (session, bin it touches), bin number in ``slot``.

    A session touches a bin when start < bin end and end > bin start, and it
    must overlap [start, end) itself. Bins run from the one holding ``start``
    up to, not including, the one holding ``end``.
    """
    check_interval(interval_s)
    first, last = slot("start_time", interval_s), slot_before("end_time", interval_s)
    if start is not None:
        s = s.where(F.col("end_time") > ts(start))
        first = F.greatest(first, slot(ts(start), interval_s))
    if end is not None:
        s = s.where(F.col("start_time") < ts(end))
        last = F.least(last, slot(ts(end), interval_s) - F.lit(1))
    return (
        s.withColumns({"_first": first, "_last": last})
        .where(F.col("_last") >= F.col("_first"))  # sequence(5, 4) would run backwards
        .withColumn("slot", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )


def occupancy_bins(s: DataFrame, interval_s: int, start=None, end=None) -> DataFrame:
    """(space_id, interval_begin_time, number_connections), non-empty bins only.

    The distinct count is planned as a first pass on (space, bin, device), so
    a crowded room is spread over tasks before its final count.
    """
    return (
        explode_bins(s.select("space_id", "mac_address", "start_time", "end_time"), interval_s, start, end)
        .groupBy("space_id", "slot")
        .agg(F.count_distinct("mac_address").alias("number_connections"))
        .where(F.col("space_id").isNotNull() & (F.col("number_connections") > 0))
        .select("space_id", slot_start("slot", interval_s).alias("interval_begin_time"), "number_connections")
    )


def occupancy_intervals(bins: DataFrame, interval_s: int) -> DataFrame:
    """Bins as (space_id, start_time, end_time, number_connections)."""
    return bins.select(
        "space_id",
        F.col("interval_begin_time").alias("start_time"),
        F.timestamp_add("SECOND", F.lit(interval_s).cast("long"), F.col("interval_begin_time")).alias("end_time"),
        "number_connections",
    )


def densify(bins: DataFrame, interval_s: int, start=None, end=None) -> DataFrame:
    """Zero rows for the absent bins of each space.

    The grid of a space runs over [start, end) or over its own first to last
    bin; its length is bounded by the time range, not by the number of rows.
    """
    lo = F.min(slot("interval_begin_time", interval_s)) if start is None else F.first(slot(ts(start), interval_s))
    hi = F.max(slot("interval_begin_time", interval_s)) if end is None else F.first(slot_before(ts(end), interval_s))
    grid = (
        bins.groupBy("space_id").agg(lo.alias("_lo"), hi.alias("_hi"))
        .where("_hi >= _lo")
        .select("space_id", F.explode(F.sequence("_lo", "_hi")).alias("slot"))
    )
    have = bins.select("space_id", slot("interval_begin_time", interval_s).alias("slot"), "number_connections")
    return grid.join(have, ["space_id", "slot"], "left").select(
        "space_id",
        slot_start("slot", interval_s).alias("interval_begin_time"),
        F.coalesce("number_connections", F.lit(0)).cast("long").alias("number_connections"),
    )
