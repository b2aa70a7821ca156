"""Dimension tables and the per-space / per-sensor profiles made from them.

Joining sessions to room metadata, faculty offices or coverage regions may
match several dimension rows per session, and that fan-out counts. Instead of
multiplying fact rows, the dimensions are folded once into one row per space
that carries the multiplicities.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from roamlens.session import sized_broadcast


@dataclass
class Dims:
    space: DataFrame
    space_metadata: DataFrame
    faculty_data: DataFrame
    region_to_coverage: DataFrame | None = None
    space_occupancy: DataFrame | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    def room_profile(self) -> DataFrame:
        """space_id -> room types with row counts, faculty rows.

        ``type_rows`` MAP<type, matching metadata rows>, ``meta_rows`` their
        sum, ``type_lo``/``type_hi`` smallest and largest type,
        ``faculty_rows`` matching faculty rows.
        """
        if "rooms" not in self._cache:
            per_type = (
                self.space_metadata.where("building_room IS NOT NULL AND type IS NOT NULL")
                .groupBy("building_room", "type")
                .agg(F.count("*").alias("n"))
            )
            meta = per_type.groupBy("building_room").agg(
                F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("type_rows"),
                F.sum("n").alias("meta_rows"),
                F.min("type").alias("type_lo"),
                F.max("type").alias("type_hi"),
            )
            faculty = self.faculty_data.groupBy(F.col("office").alias("building_room")).agg(
                F.count("*").alias("faculty_rows")
            )
            rooms = (
                self.space.select("space_id", "building_room")
                .join(meta, "building_room", "left")
                .join(faculty, "building_room", "left")
                .withColumns(
                    {
                        "meta_rows": F.coalesce("meta_rows", F.lit(0)),
                        "faculty_rows": F.coalesce("faculty_rows", F.lit(0)),
                    }
                )
            )
            self._cache["rooms"] = sized_broadcast(rooms)
        return self._cache["rooms"]

    def regions(self, exclude=()) -> DataFrame:
        """Coverage rows (sensor, space_name), hinted small when they are."""
        key = ("regions", tuple(exclude))
        if key not in self._cache:
            r = self.region_to_coverage.select(F.col("sensor").alias("sensor_id"), "space_name")
            if exclude:
                r = r.where(~F.col("space_name").isin(*exclude))
            self._cache[key] = sized_broadcast(r)
        return self._cache[key]


def type_rows(*types: str) -> Column:
    """How many metadata rows of the space have one of ``types``."""
    parts = [F.coalesce(F.try_element_at("type_rows", F.lit(t)), F.lit(0)) for t in types]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total
