"""Registered metric queries: each metric over all sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from roamlens.functions.times import SUNDAY_TO_THURSDAY
from roamlens.operators import copresence as C, metrics as M, regions as R
from roamlens.operators.faculty import single_office_share
from roamlens.operators.grains import Metric, compute, qualify
from roamlens.sources import driver_tables as T

Query = Callable[[SparkSession, str], DataFrame]

METRICS: dict[str, Metric | Callable[[], Metric]] = {
    "m01_always_on": M.always_on,
    "m02_many_connections": M.many_connections,
    "m03_short_sessions_share": M.short_sessions_share,
    "m03_short_sessions_share_by_ap": lambda: M.short_sessions_share(place="sensor_id"),
    "m04_late_nights": M.late_nights,
    "m05_single_room_type": M.single_room_type,
    "m06_off_hours": M.off_hours,
    "m09_daily_avg_hours_laptop": M.daily_avg_hours,
    "m10_daily_avg_hours_phone": lambda: M.daily_avg_hours(None, 1),
    "m11_room_type_share": M.room_type_share,
    "m12_rooms_per_day_share": M.rooms_per_day_share,
    "m13_schedule_share": M.schedule_share,
    "m13_schedule_share_by_hour": lambda: M.schedule_share(by_hour=True),
    "m13_schedule_share_sunday_week": lambda: M.schedule_share(days=SUNDAY_TO_THURSDAY),
    "m14_daytime_share": M.daytime_share,
    "m15_many_rooms": M.many_rooms,
    "m15_many_rooms_three": lambda: M.many_rooms(3),
    "m16_span_and_rooms": M.span_and_rooms,
    "m17_connected_days": M.connected_days,
    "m18_common_vs_work_rooms": M.common_vs_work_rooms,
    "m19_work_room_share": M.work_room_share,
    "m20_lab_day_share": M.lab_day_share,
    "m20_lab_day_share_per_room": lambda: M.lab_day_share(per_room=True, keep_zero=False),
    "m21_schedule_variability": M.schedule_variability,
    "m22_room_diversity": M.room_diversity,
    "m23_within_hours_share": M.within_hours_share,
    "m24_long_session_days": M.long_session_days,
    "m24_long_session_days_whole_hours": lambda: M.long_session_days(whole_hours=True),
    "m25_few_rooms_non_faculty": M.few_rooms_non_faculty,
    "m25_few_rooms_non_faculty_whole_minutes": lambda: M.few_rooms_non_faculty(whole_minutes=True),
    "m26_faculty_office_share": M.faculty_office_share,
    "m27_long_time_share": M.long_time_share,
    "m28_evening_departure": M.evening_departure,
    "m29_rooms_with_office_days": M.rooms_with_office_days,
    "m30_late_nights_count": M.late_nights_count,
    "m32_max_weekday_share": M.max_weekday_share,
    "m33_lab_weekday_share": M.lab_weekday_share,
    "m34_office_and_lab_days": M.office_and_lab_days,
    "m34_office_and_lab_days_whole_minutes": lambda: M.office_and_lab_days(whole_minutes=True),
    "m35_faculty_visits": M.faculty_visits,
    "m36_meeting_share": M.meeting_share,
    "m37_ends_in_window_days": M.ends_in_window_days,
    "m38_lab_avg_duration_days": M.lab_avg_duration_days,
    "m43_device_features": M.device_features,
}


def _metric(make: Callable[[], Metric]) -> Query:
    return lambda spark, sf: compute(make(), T.sessions(spark, sf), None, T.dims(spark, sf))


def _always_on_devices(spark: SparkSession, sf: str) -> DataFrame:
    metric = compute(M.always_on(), T.sessions(spark, sf))
    static = (F.col("avg_hours") >= 15) & (F.col("distinct_date") >= 10) & (F.col("distinct_ap") == 1)
    return qualify(metric, static, [])


QUERIES: dict[str, Query] = {name: _metric(make) for name, make in METRICS.items()} | {
    "m07_copair_laptop": lambda spark, sf: C.copair_pairs(T.sessions(spark, sf)),
    "m07_copair_laptop_qualified": lambda spark, sf: C.copair_pairs(T.sessions(spark, sf), min_share=0.8),
    "m07_copair_laptop_all": lambda spark, sf: C.copair_pairs(T.sessions(spark, sf), min_share=None),
    "m08_copair_phone_all": lambda spark, sf: C.copair_pairs(T.sessions(spark, sf), role="phone", min_share=None),
    "m08_copair_phone": lambda spark, sf: C.copair_pairs(T.sessions(spark, sf), role="phone"),
    "m08_copair_phone_qualified": lambda spark, sf: C.copair_pairs(T.sessions(spark, sf), role="phone", min_share=0.8),
    "m26_single_office_share": lambda spark, sf: single_office_share(T.sessions(spark, sf), None, T.dims(spark, sf), 0.3),
    "m31_shared_rooms": lambda spark, sf: C.shared_rooms(T.sessions(spark, sf), T.dims(spark, sf)),
    "m39_concurrent_rooms": lambda spark, sf: C.concurrent_rooms(T.sessions(spark, sf), T.dims(spark, sf)),
    "m40_dominant_room": lambda spark, sf: R.dominant_room(T.sessions(spark, sf), T.dims(spark, sf)),
    "m40_dominant_room_low_share": lambda spark, sf: R.dominant_room(T.sessions(spark, sf), T.dims(spark, sf), min_share=0.4),
    "m40_dominant_room_whole_minutes": lambda spark, sf: R.dominant_room(T.sessions(spark, sf), T.dims(spark, sf), min_share=0.4, whole_minutes=True),
    "m41_weekday_dominant": lambda spark, sf: R.weekday_dominant(T.sessions(spark, sf), T.dims(spark, sf)),
    "m41_weekday_dominant_low_share": lambda spark, sf: R.weekday_dominant(T.sessions(spark, sf), T.dims(spark, sf), min_share=0.4),
    "m41_weekday_dominant_of_sessions": lambda spark, sf: R.weekday_dominant(T.sessions(spark, sf), T.dims(spark, sf), of_sessions=True),
    "m42_copair_group": lambda spark, sf: C.copair_group(T.sessions(spark, sf), T.dims(spark, sf)),
    "m44_qualify_always_on": _always_on_devices,
}
