"""Session tables derived from the star-schema test tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roamlens.operators.bins import occupancy_bins, occupancy_intervals
from roamlens.operators.dims import Dims

# Room types by typeid (fixed values).
ROOM_TYPES = [
    "office", "conference room", "meeting room", "student lab", "elevator",
    "janitor", "kitchen", "rest room", "telecom",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    room = "((user_id*3 + event_id % (1 + user_id % 7)) % 25)"
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS mac_address",
        f"concat('ap-', CAST({room} DIV 2 AS STRING)) AS sensor_id",
        f"CAST(100 + {room} AS INT) AS space_id",
        "ts AS start_time",
        "timestampadd(SECOND, CAST(floor(value*60) AS BIGINT) * IF(user_id % 7 = 0, 24, 1), ts) AS end_time",
    )


def space(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    root = spark.sql(
        "SELECT 1 AS space_id, 'campus' AS space_name, CAST(NULL AS INT) AS parent_space_id,"
        " CAST(NULL AS STRING) AS building_room"
    )
    floors = region.selectExpr(
        "10 + r_regionkey AS space_id", "r_name AS space_name",
        "1 AS parent_space_id", "CAST(NULL AS STRING) AS building_room",
    )
    rooms = nation.selectExpr(
        "100 + n_nationkey AS space_id", "n_name AS space_name",
        "10 + n_regionkey AS parent_space_id", "n_name AS building_room",
    )
    return root.unionByName(floors).unionByName(rooms)


def space_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in ROOM_TYPES])
    typeid = F.col("n_nationkey") % 9
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("roomid"), typeid.alias("typeid"),
        F.element_at(names, typeid + 1).alias("type"), F.col("n_name").alias("building_room"),
    )


def faculty_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_name").alias("name"), F.col("n_name").alias("office"))
    )


def region_to_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr(
            "r_regionkey AS region_id", "r_name AS space_name",
            "n_nationkey DIV 2 AS wapcov_id", "concat('ap-', n_nationkey DIV 2) AS sensor",
        )
        .distinct()
    )


def space_occupancy(spark: SparkSession, sf_dir: str, interval_s: int = 900) -> DataFrame:
    return occupancy_intervals(occupancy_bins(sessions(spark, sf_dir), interval_s), interval_s)


def dims(spark: SparkSession, sf_dir: str) -> Dims:
    return Dims(
        space(spark, sf_dir),
        space_metadata(spark, sf_dir),
        faculty_data(spark, sf_dir),
        region_to_coverage(spark, sf_dir),
        space_occupancy(spark, sf_dir),
    )
