"""Session sources and the parquet sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

SESSION_SCHEMA = T.StructType(
    [
        T.StructField("mac_address", T.StringType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("space_id", T.IntegerType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
    ]
)
COUNTS_SCHEMA = "interval_begin_time TIMESTAMP_NTZ, ap STRING, `count` BIGINT"

# Names older tables use for the session columns (fixed values).
OLD_NAMES = {
    "user": "mac_address",
    "payload": "mac_address",
    "access_point": "sensor_id",
    "beginning": "start_time",
    "timeStamp": "start_time",
    "end": "end_time",
}
JDBC_DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
}


def normalise_sessions(df: DataFrame) -> DataFrame:
    """Rename older column names to the session schema."""
    return df.withColumnsRenamed({k: v for k, v in OLD_NAMES.items() if k in df.columns})


def read_sessions(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet scan of session tables (any Hadoop file system)."""
    return normalise_sessions(spark.read.parquet(*paths))


def jdbc_options(
    kind: str, host: str, port: int, database: str, query: str, user: str, password: str,
    partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 64,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a parallel JDBC read of ``query``."""
    opts = {
        "url": f"jdbc:{kind}://{host}:{port}/{database}",
        "driver": JDBC_DRIVERS[kind],
        "dbtable": f"({query}) AS q",
        "user": user,
        "password": password,
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",
    }
    if partition_column:
        lo, hi = bounds
        opts |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lo),
            "upperBound": str(hi),
            "numPartitions": str(partitions),
        }
    return opts


def read_jdbc_sessions(spark: SparkSession, **connection) -> DataFrame:
    """Sessions from PostgreSQL or MySQL, split on ``partition_column``."""
    return normalise_sessions(
        spark.read.format("jdbc").options(**jdbc_options(**connection)).load()
    )


def read_csv_counts(spark: SparkSession, path: str) -> DataFrame:
    """CSV of (interval_begin_time, ap, count)."""
    return spark.read.csv(path, header=True, schema=COUNTS_SCHEMA)


def write_asset(df: DataFrame, path: str, partition_by=()) -> None:
    """Replace one stored result."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
