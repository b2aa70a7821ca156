"""Occupancy kept current from a stream of finished sessions.

Each micro-batch is stored and the days it touches are recomputed from the store;
what changed runs along the flows of all sources seen so far, so the result does
not depend on how sessions are cut into batches. Late sessions are not dropped:
they simply touch an older day. A batch that is run again replaces what its first
run wrote and changes no bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from roamlens.operators.bin_store import BinStore, update_days
from roamlens.operators.chunks import bins_of_days
from roamlens.sources.tables import SESSION_SCHEMA


def read_session_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(SESSION_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def _store_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    (
        batch.withColumns({"ingest_batch": F.lit(batch_id), "day": F.to_date("start_time")})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_batch", "day").parquet(store)
    )


def touched_days(batch: DataFrame) -> DataFrame:
    return (
        batch.where("end_time >= start_time")
        .select(F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_time"))).alias("day"))
        .distinct()
    )


def refresh_batch(tree: DataFrame, store: str, out: str, interval_s: int) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _store_batch(batch, batch_id, store)
        mine = spark.read.parquet(store).where(F.col("ingest_batch") == batch_id)
        days = touched_days(mine)
        found = sorted(r.day for r in days.collect())
        if not found:
            return
        # prunes the store: partitions by start day, row groups by end time
        s = spark.read.parquet(store).where(
            (F.col("day") <= F.lit(found[-1])) & (F.col("end_time") >= F.lit(found[0]).cast("timestamp_ntz"))
        )
        state = BinStore(spark, out).snapshot()
        own = bins_of_days(s, days, interval_s)
        written, registry = update_days(state, own, None, mine.where("end_time >= start_time"), tree, interval_s, found)
        state.store.commit(state, written, sources=registry)

    return run


def start_occupancy_stream(
    sessions: DataFrame, tree: DataFrame, store: str, out: str, interval_s: int, checkpoint: str,
) -> StreamingQuery:
    """Run over everything available, then stop."""
    return (
        sessions.writeStream.foreachBatch(refresh_batch(tree, store, out, interval_s))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
