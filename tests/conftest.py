import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roamlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(8, partitions=4)
    yield s
    s.stop()


def sessions(spark, rows):
    """rows of (device, space, 'HH:MM' or 'YYYY-MM-DD HH:MM' start, end) on 2024-01-02."""

    def at(text):
        return (text if len(text) > 5 else f"2024-01-02 {text}") + ":00"

    data = [(d, f"ap-{sp}", sp, at(a), at(b)) for d, sp, a, b in rows]
    df = spark.createDataFrame(data, "mac_address STRING, sensor_id STRING, space_id INT, a STRING, b STRING")
    return df.selectExpr(
        "mac_address", "sensor_id", "space_id",
        "CAST(a AS TIMESTAMP_NTZ) AS start_time", "CAST(b AS TIMESTAMP_NTZ) AS end_time",
    )
