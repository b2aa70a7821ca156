"""Dominant coverage region of a device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roamlens.functions.times import MONDAY_TO_FRIDAY, in_clock, on_days, us_to
from roamlens.functions.values import ratio
from roamlens.operators.copresence import CLASSROOMS
from roamlens.operators.dims import Dims
from roamlens.operators.grains import session_columns
from roamlens.operators.scope import KEY, scope_to


def _winner(value: str) -> Column:
    return F.min(F.struct((-F.col(value)).alias("b"), "space_name"))


def dominant_room(
    sessions: DataFrame, dims: Dims, entities: DataFrame | None = None, min_share: float = 0.8,
    min_minutes: float = 10, max_rooms: int = 5, exclude=CLASSROOMS, whole_minutes: bool = False,
) -> DataFrame:
    """Top region by time among regions of enough minutes, if it holds enough
    of that time and the device saw few regions."""
    s = scope_to(sessions, entities)
    if whole_minutes:
        time = F.sum(F.timestamp_diff("MINUTE", F.col("start_time"), F.col("end_time")))
    else:
        time = F.sum("us")
    per_sensor = session_columns(s).groupBy(KEY, "sensor_id").agg(time.alias("t"))
    rooms = per_sensor.join(dims.regions(exclude), "sensor_id").groupBy(KEY, "space_name").agg(F.sum("t").alias("t"))
    enough = (F.col("t") if whole_minutes else us_to("min", F.col("t"))) >= F.lit(min_minutes)
    kept = F.when(enough, F.col("t"))
    return (
        rooms.withColumn("t_ok", kept).groupBy(KEY).agg(
            F.count("*").alias("rooms"), F.sum("t_ok").alias("qualified"),
            F.min(F.when(enough, F.struct((-F.col("t")).alias("b"), "space_name"))).alias("top"),
        )
        .where(
            F.col("top").isNotNull() & (F.col("rooms") <= max_rooms)
            & (ratio(-F.col("top.b"), "qualified") >= F.lit(min_share))
        )
        .select(KEY, F.col("top.space_name").alias("top_space_name"))
    )


def weekday_dominant(
    sessions: DataFrame, dims: Dims, entities: DataFrame | None = None, min_share: float = 0.8,
    start: str = "10:00", end: str = "17:00", days=MONDAY_TO_FRIDAY, exclude=CLASSROOMS,
    of_sessions: bool = False,
) -> DataFrame:
    """Region holding enough of the weekday daytime sessions. The whole is the
    joined rows, or (``of_sessions``) the sessions before the region join."""
    s = scope_to(sessions, entities).where(on_days("start_time", days) & in_clock("start_time", start, end))
    per_sensor = s.groupBy(KEY, "sensor_id").agg(F.count("*").alias("n"))
    rooms = per_sensor.join(dims.regions(exclude), "sensor_id").groupBy(KEY, "space_name").agg(F.sum("n").alias("n"))
    top = rooms.groupBy(KEY).agg(F.sum("n").alias("whole"), _winner("n").alias("top"))
    if of_sessions:
        raw = per_sensor.groupBy(KEY).agg(F.sum("n").alias("whole"))
        top = top.drop("whole").join(raw, KEY)
    return top.where(ratio(-F.col("top.b"), "whole") >= F.lit(min_share)).select(
        KEY, F.col("top.space_name").alias("space_name")
    )
