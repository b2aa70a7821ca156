"""The documented labeling functions and the four-level hierarchy.

Thresholds are data: ``DOCUMENTED`` holds the documented ones, ``FIXTURE``
values at which the test tables give overlapping and conflicting votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roamlens.functions.values import ratio
from roamlens.operators import metrics as M
from roamlens.operators.copresence import shared_rooms
from roamlens.operators.dims import Dims
from roamlens.operators.grains import Metric, metrics_bundle
from roamlens.operators.scope import KEY
from roamlens.operators.subsets import Level
from roamlens.operators.votes import LF, lf_predicate

# Class ids (fixed values).
STATIC, LAPTOP, PHONE = 1, 2, 3
VISITOR, RESIDENT = 4, 5
STUDENT, STAFF, FACULTY = 6, 7, 8
UNDERGRAD, GRAD = 9, 10
CLASS_NAMES = {
    STATIC: "STATIC", LAPTOP: "LAPTOP", PHONE: "PHONE", VISITOR: "VISITOR", RESIDENT: "RESIDENT",
    STUDENT: "STUDENT", STAFF: "STAFF", FACULTY: "FACULTY", UNDERGRAD: "UNDERGRAD", GRAD: "GRAD",
}

# Documented thresholds (fixed values).
DOCUMENTED = {
    "always_on_hours": 15, "always_on_days": 10, "many_connections": 50, "off_hours_share": 0.8,
    "off_hours_days": 3, "laptop_daily_avg": 0.8, "valid_room_type": 0.8, "business_hours": 0.8,
    "phone_short_sessions": 0.8, "many_rooms_per_day": 6, "many_rooms": 0.8, "many_rooms_days": 3,
    "daytime": 0.8, "visitor_span": 21, "visitor_rooms": 3, "visitor_days": 3, "visitor_common": 0.8,
    "visitor_work": 0.1, "resident_span": 21, "resident_days": 10, "resident_work": 0.1,
    "lab_days": 0.5, "variable_days": 3, "variable_bins": 5, "diverse_rooms": 6, "nine_to_five": 0.9,
    "long_office_days": 10, "few_rooms": 0.8, "faculty_office": 0.8, "faculty_long": 0.6,
    "evening": 0.8, "late_days": 10, "shared": 0.9, "weekday_spread": 0.4, "lab_weekday": 0.7,
    "office_and_lab": 0.8, "visits_share": 0.1, "visits_days": 10, "short_share": 0.8,
}
# Thresholds that select devices in the test tables (FIXTURES.md and below).
FIXTURE = DOCUMENTED | {
    "laptop_daily_avg": 0.15, "business_hours": 0.35, "daytime": 0.45, "many_rooms_per_day": 3,
    "many_rooms": 0.1, "visitor_days": 25, "nine_to_five": 0.25, "valid_room_type": 0.5,
    "phone_short_sessions": 0.7, "off_hours_share": 0.3, "visitor_span": 30, "lab_days": 0.1,
    "diverse_rooms": 1.5, "long_office_days": 3, "few_rooms": 0.4, "faculty_office": 0.3,
    "faculty_long": 0.1, "evening": 0.2, "lab_weekday": 0.2, "office_and_lab": 0.02,
    "weekday_spread": 0.22, "visits_days": 6, "late_days": 5,
}


def _c(metric: str, column: str) -> Column:
    return F.col(f"{metric}__{column}")


def _rules(level: int, t: dict) -> tuple[list[Metric], list[tuple[str, int, Column]], tuple[int, ...]]:
    """Metrics of a level, its (LF name, label, predicate) rows, its classes."""
    if level == 1:
        laptop = M.daily_avg_hours(1.5, 5, "laptop_daily_avg")
        phone = M.daily_avg_hours(None, 1, "phone_daily_avg")
        metrics = [
            M.always_on(), M.many_connections(), M.off_hours(), laptop, M.room_type_share(),
            M.schedule_share(), phone, M.many_rooms(t["many_rooms_per_day"]), M.daytime_share(),
        ]
        off = ratio(_c("off_hours", "matched_count"), _c("off_hours", "total_count"))
        rows = [
            ("static_always_on_lf", STATIC, (_c("always_on", "avg_hours") >= t["always_on_hours"])
             & (_c("always_on", "distinct_date") >= t["always_on_days"]) & (_c("always_on", "distinct_ap") == 1)),
            ("static_many_connections_single_ap_lf", STATIC,
             (_c("many_connections", "record_count") >= t["many_connections"]) & (_c("many_connections", "distinct_ap") == 1)),
            ("static_off_hour_lf", STATIC,
             (off >= t["off_hours_share"]) & (_c("off_hours", "distinct_date") >= t["off_hours_days"])),
            ("laptop_daily_avg_lf", LAPTOP, (_c("laptop_daily_avg", "qualifying_ratio") >= t["laptop_daily_avg"])
             & (_c("laptop_daily_avg", "total_days") >= 1)),
            ("laptop_valid_room_type_lf", LAPTOP, _c("room_type_share", "percentage") >= t["valid_room_type"]),
            ("laptop_weekday_business_hours_lf", LAPTOP, _c("schedule_share", "percentage") >= t["business_hours"]),
            ("phone_short_sessions_lf", PHONE, (_c("phone_daily_avg", "qualifying_ratio") >= t["phone_short_sessions"])
             & (_c("phone_daily_avg", "total_days") >= 1)),
            ("phone_many_rooms_lf", PHONE,
             (_c("many_rooms", "ratio") >= t["many_rooms"]) & (_c("many_rooms", "total_day_count") >= t["many_rooms_days"])),
            ("phone_weekday_daytime_lf", PHONE, _c("daytime_share", "percentage") >= t["daytime"]),
        ]
        return metrics, rows, (STATIC, LAPTOP, PHONE)
    if level == 2:
        metrics = [M.span_and_rooms(), M.connected_days(), M.common_vs_work_rooms(), M.work_room_share()]
        rows = [
            ("visitor_short_span_lf", VISITOR, (_c("span_and_rooms", "days_span") <= t["visitor_span"])
             & (_c("span_and_rooms", "unique_rooms") <= t["visitor_rooms"])),
            ("visitor_few_days_lf", VISITOR, _c("connected_days", "connected_days") <= t["visitor_days"]),
            ("visitor_common_rooms_lf", VISITOR, (_c("common_vs_work_rooms", "common_pct") >= t["visitor_common"])
             & (_c("common_vs_work_rooms", "work_pct") <= t["visitor_work"])),
            ("resident_long_span_lf", RESIDENT, _c("span_and_rooms", "days_span") > t["resident_span"]),
            ("resident_many_days_lf", RESIDENT, _c("connected_days", "connected_days") >= t["resident_days"]),
            ("resident_work_room_usage_lf", RESIDENT, _c("work_room_share", "work_pct") >= t["resident_work"]),
        ]
        return metrics, rows, (VISITOR, RESIDENT)
    if level == 3:
        metrics = [
            M.lab_day_share(), M.schedule_variability(), M.room_diversity(), M.within_hours_share(),
            M.long_session_days(), M.few_rooms_non_faculty(), M.faculty_office_share(), M.long_time_share(),
            M.evening_departure(),
        ]
        rows = [
            ("student_lab_presence_lf", STUDENT, _c("lab_day_share", "lab_day_pct") >= t["lab_days"]),
            ("student_variable_schedule_lf", STUDENT, (_c("schedule_variability", "day_count") > t["variable_days"])
             & (_c("schedule_variability", "bin_pair_count") >= t["variable_bins"])),
            ("student_diverse_rooms_lf", STUDENT, (_c("room_diversity", "avg_daily_rooms") >= t["diverse_rooms"])
             & (_c("room_diversity", "compliant_days") == _c("room_diversity", "total_days"))),
            ("staff_9to5_schedule_lf", STAFF, _c("within_hours_share", "schedule_pct") >= t["nine_to_five"]),
            ("staff_long_office_sessions_lf", STAFF, _c("long_session_days", "long_session_days") >= t["long_office_days"]),
            ("staff_few_rooms_non_faculty_lf", STAFF, _c("few_rooms_non_faculty", "pct") >= t["few_rooms"]),
            ("faculty_office_dominance_lf", FACULTY, _c("faculty_office_share", "faculty_pct") >= t["faculty_office"]),
            ("faculty_long_sessions_lf", FACULTY, _c("long_time_share", "long_pct") >= t["faculty_long"]),
            ("faculty_evening_departure_lf", FACULTY, _c("evening_departure", "evening_pct") >= t["evening"]),
        ]
        return metrics, rows, (STUDENT, STAFF, FACULTY)
    metrics = [
        M.late_nights_count(), M.max_weekday_share(), M.lab_weekday_share(), M.office_and_lab_days(), M.faculty_visits(),
    ]
    rows = [
        ("undergrad_late_nights_lf", UNDERGRAD, _c("late_nights_count", "late_days") >= t["late_days"]),
        ("undergrad_even_day_spread_lf", UNDERGRAD, _c("max_weekday_share", "max_day_pct") <= t["weekday_spread"]),
        ("grad_student_lab_weekday_lf", GRAD, _c("lab_weekday_share", "lab_pct") >= t["lab_weekday"]),
        ("grad_office_and_lab_lf", GRAD, _c("office_and_lab_days", "pct") >= t["office_and_lab"]),
        ("grad_faculty_office_visits_lf", GRAD,
         (_c("faculty_visits", "faculty_pct") >= t["visits_share"]) & (_c("faculty_visits", "faculty_days") >= t["visits_days"])),
    ]
    return metrics, rows, (UNDERGRAD, GRAD)


def level_sources(level: int, s: DataFrame, dims: Dims, entities: DataFrame | None = None, t: dict = DOCUMENTED) -> list[tuple[DataFrame, list[LF]]]:
    """[(metric table, LFs)] of one documented level: one bundle, and the
    shared-rooms metric of level 4 beside it."""
    metrics, rows, allowed = _rules(level, t)
    bundle = metrics_bundle(s, metrics, entities, dims)
    out = [(bundle, [lf_predicate(n, label, p, allowed) for n, label, p in rows])]
    if level == 4:
        rooms = shared_rooms(s, dims, entities)
        out.append((rooms, [lf_predicate("undergrad_shared_rooms_lf", UNDERGRAD, F.col("shared_pct") >= t["shared"], allowed)]))
    return out


def flat_sources(s: DataFrame, dims: Dims, entities: DataFrame | None = None, t: dict = DOCUMENTED) -> list[tuple[DataFrame, list[LF]]]:
    """The three LFs of the flat device classification."""
    allowed = (STATIC, LAPTOP, PHONE)
    hours = M.schedule_share(by_hour=True, name="connected_duration")
    phone = M.daily_avg_hours(None, 1, "phone_daily_avg")
    bundle = metrics_bundle(s, [M.short_sessions_share(), hours, phone], entities, dims)
    return [(bundle, [
        lf_predicate("static_short_irregular_sessions_lf", STATIC,
                     (_c("short_sessions_share", "connection_count") >= t["short_share"])
                     & (_c("short_sessions_share", "distinct_ap") == 1), allowed),
        lf_predicate("laptop_total_connected_duration_lf", LAPTOP,
                     _c("connected_duration", "percentage") >= t["business_hours"], allowed),
        # the flat rule filters inside its SQL, so its LF only asks for a row
        lf_predicate("phone_1_hour_average_lf", PHONE,
                     (_c("phone_daily_avg", "qualifying_ratio") >= t["phone_short_sessions"])
                     & (_c("phone_daily_avg", "total_days") >= 1), allowed),
    ])]


def hierarchy(s: DataFrame, dims: Dims, t: dict = DOCUMENTED, epochs: int = 100, min_confidence: float = 0.5) -> list[Level]:
    """device -> visitor/resident -> student/staff/faculty -> undergrad/grad."""

    def pick(class_id: int) -> dict:
        return {"labels": {str(class_id): {"min_confidence": min_confidence}}}

    def metrics(level: int):
        return lambda entities: level_sources(level, s, dims, entities, t)

    return [
        Level("device", metrics(1), {"static": pick(STATIC), "laptop": pick(LAPTOP), "phone": pick(PHONE), "people": None}, epochs=epochs),
        Level("person", metrics(2), {"visitor": pick(VISITOR), "resident": pick(RESIDENT)}, "people", epochs=epochs),
        Level("resident", metrics(3), {"student": pick(STUDENT), "staff": pick(STAFF), "faculty": pick(FACULTY)}, "resident", epochs=epochs),
        Level("student", metrics(4), {"undergrad": pick(UNDERGRAD), "grad": pick(GRAD)}, "student", epochs=epochs),
    ]
