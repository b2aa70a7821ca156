"""Chunk ledger of the occupancy store: staleness, coverage, bins of days."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from roamlens.functions.times import align_down, day, slot_start, slot_before, ts
from roamlens.operators.bins import occupancy_bins
from roamlens.operators.ordered import running_max
from roamlens.operators.tree import ancestors, closure, descendants
from roamlens.session import sized_broadcast

DAY_S = 86400
LEDGER_SCHEMA = (
    "space_id INT, interval_seconds INT, chunk_start TIMESTAMP_NTZ, chunk_end TIMESTAMP_NTZ,"
    " space_type STRING, status STRING, completed_at TIMESTAMP_NTZ"
)


def stale_chunks(ledger: DataFrame, s: DataFrame, tree: DataFrame, root: int, interval_s: int, start, end) -> DataFrame:
    """Completed chunks to throw away before a refresh of [start, end).

    A source chunk is stale when it was completed before the newest session end
    of its space that it should contain; the chunks of all spaces above a stale
    source go with it.
    """
    inside = sized_broadcast(descendants(tree, root).select("space_id"))
    latest = (
        s.where((F.col("start_time") < ts(end)) & (F.col("end_time") > ts(start)))
        .join(inside, "space_id", "left_semi")
        .groupBy("space_id").agg(F.max("end_time").alias("latest"))
    )
    done = ledger.where((F.col("status") == "COMPLETED") & (F.col("interval_seconds") == interval_s))
    source = (
        done.join(latest, "space_id")
        .where(
            (F.col("chunk_start") < F.col("latest")) & (F.col("chunk_end") > ts(start))
            & (F.col("completed_at") < F.col("latest"))
        )
        .drop("latest")
    )
    above = (
        closure(tree).where("depth > 0")
        .join(source.select(F.col("space_id").alias("descendant")).distinct(), "descendant", "left_semi")
        .select(F.col("ancestor").alias("space_id")).distinct()
        .join(inside, "space_id", "left_semi")
    )
    parents = done.where(
        (F.col("chunk_start") < ts(end)) & (F.col("chunk_end") > ts(start))
    ).join(above, "space_id", "left_semi")
    return source.unionByName(parents).distinct()


def coverage_gaps(ledger: DataFrame, spaces: DataFrame, interval_s: int, start, end, force: bool = False) -> DataFrame:
    """(space_id, gap_start, gap_end): parts of [start, end) no completed chunk
    covers; ``force`` asks for the whole window of every space."""
    wanted = spaces.select("space_id").distinct()
    if force:
        return wanted.select("space_id", ts(start).alias("gap_start"), ts(end).alias("gap_end"))
    done = (
        ledger.where(
            (F.col("status") == "COMPLETED") & (F.col("interval_seconds") == interval_s)
            & (F.col("chunk_start") < ts(end)) & (F.col("chunk_end") > ts(start))
        )
        .join(wanted, "space_id", "left_semi")
        .groupBy("space_id", "chunk_start").agg(F.max("chunk_end").alias("chunk_end"))
    )
    edge = wanted.select("space_id", ts(end).alias("chunk_start"), ts(end).alias("chunk_end"))
    covered = running_max(
        done.unionByName(edge), ["space_id"], ["chunk_start"], "chunk_end", day("chunk_start"), "reached"
    )
    cursor = F.greatest(F.coalesce("reached", ts(start)), ts(start))
    return covered.select(
        "space_id", cursor.alias("gap_start"), F.col("chunk_start").alias("gap_end")
    ).where("gap_end > gap_start")


def align_gaps(gaps: DataFrame, width_s: int = DAY_S) -> DataFrame:
    """Gaps widened to whole slots, so no bin is computed from half its sessions."""
    return gaps.select(
        "space_id",
        align_down("gap_start", width_s).alias("gap_start"),
        slot_start(slot_before("gap_end", width_s) + F.lit(1), width_s).alias("gap_end"),
    )


def days_of(gaps: DataFrame) -> DataFrame:
    last = F.to_date(slot_start(slot_before("gap_end", DAY_S), DAY_S))
    return gaps.select(
        F.explode(F.sequence(F.to_date("gap_start"), last)).alias("day")
    ).distinct()


def bins_of_days(s: DataFrame, days: DataFrame, interval_s: int) -> DataFrame:
    """Occupancy bins of the given days only.

    The range of the days is a plain filter that reaches the scan; sessions are
    then cut to the (session, day) pairs in ``days`` by a join before they are
    exploded into bins.
    """
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if span.lo is not None:
        low, high = F.lit(span.lo).cast("timestamp_ntz"), F.lit(span.hi + timedelta(days=1)).cast("timestamp_ntz")
        s = s.where((F.col("start_time") < high) & ((F.col("end_time") >= low) | (F.col("start_time") >= low)))
    point = F.col("end_time") <= F.col("start_time")
    last = F.when(point, F.to_date("start_time")).otherwise(F.to_date("end_time"))
    pieces = (
        s.select("space_id", "mac_address", "start_time", "end_time")
        .withColumn("day", F.explode(F.sequence(F.to_date("start_time"), last)))
        .join(sized_broadcast(days.select("day")), "day", "left_semi")
    )
    midnight = F.col("day").cast("timestamp_ntz")
    cut_start = F.greatest("start_time", midnight)
    cut_end = F.when(point, F.col("end_time")).otherwise(
        F.least("end_time", F.timestamp_add("DAY", F.lit(1), midnight))
    )
    # a session that ended at midnight leaves an empty piece on the new day
    cut = pieces.where(point | (cut_end > cut_start)).select(
        "space_id", "mac_address", cut_start.alias("start_time"), cut_end.alias("end_time")
    )
    return occupancy_bins(cut, interval_s)


def drop_stale(ledger: DataFrame, stale: DataFrame) -> DataFrame:
    """The ledger without the chunks of ``stale``."""
    return ledger.join(stale, ["space_id", "interval_seconds", "chunk_start", "chunk_end"], "left_anti")


def occupancy_series(bins: DataFrame, space_id: int, start=None, end=None) -> DataFrame:
    """Ordered series of one space, one row per bin."""
    df = bins.where(F.col("space_id") == F.lit(space_id))
    if start is not None:
        df = df.where(F.col("interval_begin_time") >= ts(start))
    if end is not None:
        df = df.where(F.col("interval_begin_time") < ts(end))
    return (
        df.groupBy("space_id", "interval_begin_time")
        .agg(F.max("number_connections").alias("number_connections"))
        .orderBy("interval_begin_time")
    )


def covering_datasets(datasets: DataFrame, tree: DataFrame, space_id: int) -> DataFrame:
    """Datasets whose root is the space or one of its ancestors."""
    up = ancestors(tree, space_id).select(F.col("space_id").alias("root_space_id"))
    return datasets.join(up, "root_space_id", "left_semi")
