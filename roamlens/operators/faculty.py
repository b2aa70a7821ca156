"""Share of the single busiest faculty office (older form of the office rule)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roamlens.functions.values import ratio
from roamlens.operators.dims import Dims
from roamlens.operators.scope import KEY, scope_to


def single_office_share(sessions: DataFrame, entities: DataFrame | None, dims: Dims, min_share: float = 0.8) -> DataFrame:
    """(count, total) of each faculty row whose room alone reaches the share.

    One row per matching faculty row, so two professors in one office give two.
    """
    per_space = scope_to(sessions, entities).groupBy(KEY, "space_id").agg(F.count("*").alias("n"))
    rooms = dims.room_profile().select("space_id", "building_room", "faculty_rows")
    per_room = (
        per_space.join(rooms, "space_id").groupBy(KEY, "building_room")
        .agg(F.sum("n").alias("count"), F.max("faculty_rows").alias("_rows"))
    )
    total = per_space.groupBy(KEY).agg(F.sum("n").alias("total"))
    return (
        per_room.where("_rows > 0").join(total, KEY)
        .where(ratio("count", "total") >= F.lit(min_share))
        .select(KEY, "count", "total", F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_i"))
        .drop("_i")
    )
