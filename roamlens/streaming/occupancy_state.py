"""Occupancy from a session stream with the devices seen kept as state.

State is keyed by (space, day, part of the devices) and maps a bin to the devices
counted in it, so exact distinct counts need no look back at stored sessions: a
batch emits by how much each bin grows. Parts spread a crowded room over tasks;
their devices are disjoint and their counts add up. The changes run along the
flows of the registered sources into the bin store, whose manifest also names the
batch, so a batch that is run again is not counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from roamlens.functions.times import check_interval, slot_start
from roamlens.operators.bin_store import BinStore, apply_changes
from roamlens.operators.bins import explode_bins
from roamlens.session import durable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class NewDevices(StatefulProcessor):
    """(space_id, slot, change): devices of a bin that no earlier batch has brought.

    With ``keep_days`` a timer drops the state of a day so long after the day has
    passed the watermark.
    """

    def __init__(self, keep_days: int | None):
        self.keep_days = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "slot LONG", "devices ARRAY<STRING>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        space, day, _ = key
        arrived: dict[int, set] = {}
        for batch in rows:
            for slot, devices in batch.groupby("slot")["mac_address"]:
                arrived.setdefault(int(slot), set()).update(devices)
        grown = []
        for slot, devices in arrived.items():
            known = self.seen.getValue((slot,)) if self.seen.containsKey((slot,)) else None
            new = devices.difference(known[0]) if known else devices
            if new:
                self.seen.updateValue((slot,), ((list(known[0]) if known else []) + sorted(new),))
                grown.append((space, slot, len(new)))
        if self.keep_days is not None:
            self.handle.registerTimer(int(day) * DAY_MS + (self.keep_days + 1) * DAY_MS)
        yield pd.DataFrame(grown, columns=["space_id", "slot", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame([], columns=["space_id", "slot", "change"])

    def close(self) -> None:
        pass


def device_changes(sessions: DataFrame, interval_s: int, parts: int = 4, keep_days: int | None = None) -> DataFrame:
    """A stream of (space_id, interval_begin_time, change) from a stream of sessions.

    Without ``keep_days`` state is kept for good and sessions may come as late as
    they like. With it, the state of a day goes when the latest session start is
    that many days past it, and sessions later than that must go to a refresh.
    """
    check_interval(interval_s)
    mode = "None"
    if keep_days is not None:
        start = F.col("start_time").cast("timestamp")
        sessions = sessions.withColumn("_event", start).withWatermark("_event", f"{keep_days} days")
        mode = "EventTime"
    kept = ["space_id", "mac_address", "start_time", "end_time"] + (["_event"] if keep_days is not None else [])
    bins = explode_bins(sessions.where("space_id IS NOT NULL AND mac_address IS NOT NULL").select(*kept), interval_s)
    day = F.floor(F.col("slot") * interval_s / F.lit(86_400)).cast("long")
    keyed = bins.withColumns({"day": day, "part": F.pmod(F.xxhash64("mac_address"), F.lit(parts)).cast("int")})
    grown = keyed.groupBy("space_id", "day", "part").transformWithStateInPandas(
        NewDevices(keep_days), "space_id INT, slot LONG, change LONG", "Append", mode
    )
    return grown.select("space_id", slot_start("slot", interval_s).alias("interval_begin_time"), "change")


def add_changes(tree: DataFrame, out: str, interval_s: int, name: str) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function: one snapshot of the store per batch with changes."""

    def run(batch: DataFrame, batch_id: int) -> None:
        state = BinStore(batch.sparkSession, out).snapshot()
        if state.batches.get(name, -1) >= batch_id:
            return
        changes = durable(batch.groupBy("space_id", "interval_begin_time").agg(F.sum("change").alias("change")))
        if not changes.isEmpty():
            written, registry = apply_changes(state, changes, changes, tree, interval_s)
            state.store.commit(state, written, sources=registry, batch=(name, batch_id))

    return run


def start_stateful_occupancy(
    sessions: DataFrame, tree: DataFrame, out: str, interval_s: int, checkpoint: str, parts: int = 4,
    keep_days: int | None = None, name: str = "sessions",
) -> StreamingQuery:
    """Run over everything available, then stop."""
    spark: SparkSession = sessions.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return (
            device_changes(sessions, interval_s, parts, keep_days)
            .writeStream.foreachBatch(add_changes(tree, out, interval_s, name)).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
