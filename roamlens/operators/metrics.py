"""Behaviour metrics per device.

Each function returns a :class:`Metric`; ``compute`` runs one, ``metrics_bundle``
many. Literals of the documented rules are keyword arguments. Where the older
form of a rule means something else (whole minutes, another day set, sensors
instead of spaces), that is an option.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from roamlens.functions.times import (
    MONDAY_TO_FRIDAY, at_or_after, at_or_before, clock_us, hour_bin, in_clock, on_days,
    tod_us, us_to, whole,
)
from roamlens.functions.values import distinct_where, ratio, sum_where
from roamlens.operators.dims import type_rows
from roamlens.operators.grains import Metric

# Room type sets of the documented rules (fixed values).
WORK_TYPES = ("conference room", "office", "meeting room", "student lab")
COMMON_TYPES = ("elevator", "rest room", "kitchen", "conference room", "meeting room")
DESK_TYPES = ("office", "student lab")
MEETING_TYPES = ("meeting room", "conference room")
FACULTY_TYPES = ("office", "conference room", "meeting room")
STAFF_TYPES = ("office", "meeting room")
LAB = "student lab"


def _n() -> dict[str, Column]:
    return {"n": F.count(F.lit(1))}


def _us() -> dict[str, Column]:
    return {"us": F.sum("us")}


def _sum_n() -> dict[str, Column]:
    return {"n": F.sum("n")}


def _days() -> dict[str, Column]:
    return {"days": F.count_distinct("day")}


def _day_rows() -> dict[str, Column]:
    return {"day_rows": F.count(F.lit(1))}


def _hours_per_session() -> Column:
    return F.col("us") / F.lit(1e6) / F.col("n") / F.lit(3600.0)


def _weighted(n: str, *types: str) -> Column:
    """Sessions joined to metadata rows of the types, fan-out kept."""
    return F.sum(F.col(n) * type_rows(*types))


def always_on() -> Metric:
    return Metric(
        "always_on", {**_n(), **_us()}, keys=("day", "sensor_id"),
        entity={**_sum_n(), **_us(), **_days(), "aps": F.count_distinct("sensor_id")},
        output={"avg_hours": _hours_per_session(), "distinct_date": F.col("days"), "distinct_ap": F.col("aps")},
    )


def many_connections() -> Metric:
    return Metric(
        "many_connections", {**_n()}, keys=("sensor_id",),
        entity={**_sum_n(), "aps": F.count_distinct("sensor_id")},
        output={"record_count": F.col("n"), "distinct_ap": F.col("aps")},
    )


def short_sessions_share(max_hours: float = 2, place: str = "space_id") -> Metric:
    p = "short_sessions_share"
    short = F.col("us") <= F.lit(int(max_hours * 3_600_000_000))
    return Metric(
        p, {**_n(), f"{p}_m": F.count_if(short)}, keys=(place,),
        entity={**_sum_n(), f"{p}_short": F.sum(f"{p}_m"), f"{p}_places": F.count_distinct(place)},
        output={"connection_count": ratio(f"{p}_short", "n"), "distinct_ap": F.col(f"{p}_places")},
    )


def late_nights(start: str = "22:00", end: str = "05:00") -> Metric:
    p = "late_nights"
    night = at_or_after("end_time", start) | at_or_before("start_time", end)
    return Metric(
        p, {f"{p}_m": F.count_if(night)}, keys=("day",),
        entity={**_days(), f"{p}_nights": distinct_where(F.col(f"{p}_m") > 0, "day")},
        output={"total_days": F.col("days"), "night_days": F.col(f"{p}_nights")},
        present=F.col(f"{p}_nights") > 0,
    )


def single_room_type(max_spaces: int = 2) -> Metric:
    p = "single_room_type"
    known = F.col(f"{p}_meta") > 0
    return Metric(
        p, {**_n()}, keys=("day", "space_id"), rooms=True,
        room={f"{p}_meta": F.max("meta_rows"), f"{p}_lo": F.min("type_lo"), f"{p}_hi": F.max("type_hi")},
        day={
            f"{p}_spaces": F.count(F.when(known, F.col("space_id"))),
            f"{p}_lo": F.min(F.when(known, F.col(f"{p}_lo"))),
            f"{p}_hi": F.max(F.when(known, F.col(f"{p}_hi"))),
        },
        entity={
            f"{p}_match": F.count_if(
                F.col(f"{p}_spaces").between(1, max_spaces) & (F.col(f"{p}_lo") == F.col(f"{p}_hi"))
            ),
            f"{p}_total": F.count_if(F.col(f"{p}_spaces") > 0),
        },
        output={"matching_count": F.col(f"{p}_match"), "total_count": F.col(f"{p}_total")},
        present=F.col(f"{p}_match") > 0,
    )


def off_hours(start: str = "22:00", end: str = "05:00") -> Metric:
    p = "off_hours"
    off = at_or_after("start_time", start) | at_or_before("end_time", end)
    return Metric(
        p, {**_n(), f"{p}_m": F.count_if(off)}, keys=("day",),
        entity={
            **_sum_n(), f"{p}_match": F.sum(f"{p}_m"),
            f"{p}_days": distinct_where(F.col(f"{p}_m") > 0, "day"),
        },
        output={"matched_count": F.col(f"{p}_match"), "distinct_date": F.col(f"{p}_days"), "total_count": F.col("n")},
        present=F.col(f"{p}_match") > 0,
    )


def daily_avg_hours(lo: float | None = 1.5, hi: float | None = 5, name: str = "daily_avg_hours") -> Metric:
    avg, ok = _hours_per_session(), F.lit(True)
    if lo is not None:
        ok = ok & (avg >= F.lit(float(lo)))
    if hi is not None:
        ok = ok & (avg <= F.lit(float(hi)))
    return Metric(
        name, {**_n(), **_us()}, keys=("day",), day={**_sum_n(), **_us()},
        entity={**_day_rows(), f"{name}_ok": F.count_if(ok)},
        output={
            "total_days": F.col("day_rows"), "qualifying_days": F.col(f"{name}_ok"),
            "qualifying_ratio": ratio(f"{name}_ok", "day_rows"),
        },
    )


def room_type_share(types=WORK_TYPES, keep_zero: bool = True, column: str = "percentage", name: str = "room_type_share") -> Metric:
    return Metric(
        name, {**_n()}, keys=("space_id",), rooms=True,
        entity={**_sum_n(), f"{name}_hit": _weighted("n", *types)},
        output={column: ratio(f"{name}_hit", "n")},
        present=None if keep_zero else F.col(f"{name}_hit") > 0,
    )


def work_room_share(types=DESK_TYPES) -> Metric:
    return room_type_share(types, True, "work_pct", "work_room_share")


def meeting_share(types=MEETING_TYPES) -> Metric:
    return room_type_share(types, False, "percentage", "meeting_share")


def common_vs_work_rooms(common=COMMON_TYPES, work=DESK_TYPES) -> Metric:
    p = "common_vs_work_rooms"
    return Metric(
        p, {**_n()}, keys=("space_id",), rooms=True,
        entity={
            **_sum_n(), f"{p}_common": _weighted("n", *common), f"{p}_work": _weighted("n", *work),
            f"{p}_known": F.sum(F.col("n") * F.coalesce("meta_rows", F.lit(0))),
        },
        output={"common_pct": ratio(f"{p}_common", "n"), "work_pct": ratio(f"{p}_work", "n")},
        present=F.col(f"{p}_known") > 0,
    )


def rooms_per_day_share(lo: int = 2, hi: int = 6) -> Metric:
    """Share of days with lo <= rooms < hi."""
    p = "rooms_per_day_share"
    return Metric(
        p, {**_n()}, keys=("day", "space_id"), room={**_sum_n()}, day={"day_rooms": F.count("space_id")},
        entity={**_day_rows(), f"{p}_ok": F.count_if((F.col("day_rooms") >= lo) & (F.col("day_rooms") < hi))},
        output={"percentage": ratio(f"{p}_ok", "day_rows"), "day_count": F.col("day_rows")},
        present=F.col(f"{p}_ok") > 0,
    )


def schedule_share(
    start: str = "09:00", end: str = "21:00", days=MONDAY_TO_FRIDAY, keep_zero: bool = False,
    by_hour: bool = False, name: str = "schedule_share",
) -> Metric:
    """Share of sessions starting on ``days`` at or after ``start`` and ending
    at or before ``end``; ``by_hour`` compares whole hours (21:59 passes 21)."""
    if by_hour:
        inside = (F.hour("start_time") >= int(start[:2])) & (F.hour("end_time") <= int(end[:2]))
    else:
        inside = at_or_after("start_time", start) & at_or_before("end_time", end)
    return Metric(
        name, {**_n(), f"{name}_m": F.count_if(on_days("start_time", days) & inside)},
        entity={**_sum_n(), f"{name}_ok": F.sum(f"{name}_m")},
        output={"percentage": ratio(f"{name}_ok", "n")},
        present=None if keep_zero else F.col(f"{name}_ok") > 0,
    )


def daytime_share(start: str = "08:00", end: str = "22:00", days=MONDAY_TO_FRIDAY) -> Metric:
    return schedule_share(start, end, days, True, name="daytime_share")


def many_rooms(min_rooms: int = 6, min_minutes: float = 2) -> Metric:
    p = "many_rooms"
    long_enough = us_to("min", F.col("us")) >= F.lit(float(min_minutes))
    return Metric(
        p, {**_us()}, keys=("day", "space_id"), room={**_us()},
        day={f"{p}_rooms": F.count(F.when(long_enough, F.col("space_id")))},
        entity={**_day_rows(), f"{p}_ok": F.count_if(F.col(f"{p}_rooms") >= min_rooms)},
        output={"total_day_count": F.col("day_rows"), "ratio": ratio(f"{p}_ok", "day_rows")},
    )


def span_and_rooms() -> Metric:
    return Metric(
        "span_and_rooms",
        {"first_start": F.min("start_time"), "last_end": F.max("end_time")}, keys=("space_id",),
        entity={
            "first_start": F.min("first_start"), "last_end": F.max("last_end"),
            "spaces": F.count_distinct("space_id"),
        },
        output={
            "days_span": F.datediff(F.to_date("last_end"), F.to_date("first_start")),
            "unique_rooms": F.col("spaces"),
        },
    )


def connected_days() -> Metric:
    return Metric(
        "connected_days", {**_n()}, keys=("day",), entity={**_days()},
        output={"connected_days": F.col("days")},
    )


def lab_day_share(min_minutes: float = 10, types=(LAB,), per_room: bool = False, keep_zero: bool = True) -> Metric:
    """Share of days with enough time in labs: the day's total over all labs,
    or (``per_room``, whole minutes) at least one lab that reaches it alone."""
    p = "lab_day_share"
    if per_room:
        measures = {f"{p}_min": F.sum(whole("MINUTE", "start_time", "end_time"))}
        hit = (F.col(f"{p}_min") >= F.lit(min_minutes)) & (F.col(f"{p}_rows") > 0)
        room = {f"{p}_min": F.sum(f"{p}_min"), f"{p}_rows": F.max(type_rows(*types))}
        day = {f"{p}_hit": F.max(F.when(hit, 1).otherwise(0))}
    else:
        measures = {**_us()}
        room = {f"{p}_us": F.sum(F.col("us") * type_rows(*types)), f"{p}_rows": F.max(type_rows(*types))}
        enough = us_to("min", F.sum(f"{p}_us")) >= F.lit(float(min_minutes))
        day = {f"{p}_hit": F.when(enough & (F.max(f"{p}_rows") > 0), 1).otherwise(0)}
    return Metric(
        p, measures, keys=("day", "space_id"), rooms=True, room=room, day=day,
        entity={**_day_rows(), f"{p}_ok": F.sum(f"{p}_hit")},
        output={"total_day_count": F.col("day_rows"), "lab_day_pct": ratio(f"{p}_ok", "day_rows")},
        present=None if keep_zero else F.col(f"{p}_ok") > 0,
    )


def schedule_variability(width: int = 2) -> Metric:
    pair = F.concat_ws("-", hour_bin("first_start", width), hour_bin("last_end", width))
    return Metric(
        "schedule_variability",
        {"first_start": F.min("start_time"), "last_end": F.max("end_time")}, keys=("day",),
        day={"first_start": F.min("first_start"), "last_end": F.max("last_end")},
        entity={**_day_rows(), "bin_pairs": F.count_distinct(pair)},
        output={"day_count": F.col("day_rows"), "bin_pair_count": F.col("bin_pairs")},
    )


def room_diversity(max_share: float = 0.5) -> Metric:
    p = "room_diversity"
    return Metric(
        p, {**_n()}, keys=("day", "space_id"), room={**_sum_n()},
        day={"day_rooms": F.count("space_id"), f"{p}_top": ratio(F.max("n"), F.sum("n"))},
        entity={
            **_day_rows(), "day_rooms_sum": F.sum("day_rooms"),
            f"{p}_ok": F.count_if(F.col(f"{p}_top") <= F.lit(float(max_share))),
        },
        output={
            "avg_daily_rooms": ratio("day_rooms_sum", "day_rows"),
            "total_days": F.col("day_rows"), "compliant_days": F.col(f"{p}_ok"),
        },
    )


def within_hours_share(start: str = "09:00", end: str = "17:00") -> Metric:
    p = "within_hours_share"
    inside = in_clock("start_time", start, end) & in_clock("end_time", start, end)
    return Metric(
        p, {**_n(), f"{p}_m": F.count_if(inside)},
        entity={**_sum_n(), f"{p}_ok": F.sum(f"{p}_m")},
        output={"scheduled_count": F.col(f"{p}_ok"), "total_count": F.col("n"), "schedule_pct": ratio(f"{p}_ok", "n")},
        present=F.col(f"{p}_ok") > 0,
    )


def long_session_days(types=STAFF_TYPES, min_hours: float = 2, whole_hours: bool = False) -> Metric:
    p = "long_session_days"
    if whole_hours:
        long = whole("HOUR", "start_time", "end_time") >= F.lit(int(min_hours))
    else:
        long = us_to("h", F.col("us")) >= F.lit(float(min_hours))
    return Metric(
        p, {f"{p}_m": F.count_if(long)}, keys=("day", "space_id"), rooms=True,
        entity={f"{p}_days": distinct_where((F.col(f"{p}_m") > 0) & (type_rows(*types) > 0), "day")},
        output={"long_session_days": F.col(f"{p}_days")},
        present=F.col(f"{p}_days") > 0,
    )


def _room_minutes(p: str, min_minutes: float, whole_minutes: bool) -> tuple[dict, dict, Column]:
    """Measures, room aggregate and the test 'room reached min_minutes that day'."""
    if whole_minutes:
        m = {"whole_min": F.sum(whole("MINUTE", "start_time", "end_time"))}
        return m, {"whole_min": F.sum("whole_min")}, F.col("whole_min") >= F.lit(min_minutes)
    return {**_us()}, {**_us()}, us_to("min", F.col("us")) >= F.lit(float(min_minutes))


def few_rooms_non_faculty(max_rooms: int = 2, min_minutes: float = 10, type_: str = "office", whole_minutes: bool = False) -> Metric:
    p = "few_rooms_non_faculty"
    measures, room, enough = _room_minutes(p, min_minutes, whole_minutes)
    office = (F.col(f"{p}_type") > 0) & (F.col(f"{p}_fac") == 0)
    return Metric(
        p, measures, keys=("day", "space_id"), rooms=True,
        room={
            **room, f"{p}_type": F.max(type_rows(type_)),
            f"{p}_fac": F.max(F.coalesce("faculty_rows", F.lit(0))),
        },
        day={
            f"{p}_rooms": F.count(F.when(enough, F.col("space_id"))),
            f"{p}_kept": F.count_if(enough),
            f"{p}_office": F.max(F.when(enough & office, 1).otherwise(0)),
        },
        entity={
            **_day_rows(),
            f"{p}_ok": F.count_if(
                (F.col(f"{p}_kept") > 0) & (F.col(f"{p}_rooms") <= max_rooms) & (F.col(f"{p}_office") == 1)
            ),
        },
        output={"pct": ratio(f"{p}_ok", "day_rows")},
    )


def faculty_office_share() -> Metric:
    p = "faculty_office_share"
    return Metric(
        p, {**_n()}, keys=("space_id",), rooms=True,
        entity={**_sum_n(), f"{p}_hit": F.sum(F.col("n") * F.coalesce("faculty_rows", F.lit(0)))},
        output={"faculty_pct": ratio(f"{p}_hit", "n")},
    )


def long_time_share(types=FACULTY_TYPES, min_seconds: int = 7200) -> Metric:
    p = "long_time_share"
    long = F.col("us") >= F.lit(min_seconds * 1_000_000)
    return Metric(
        p, {**_us(), f"{p}_m": sum_where(long, "us"), f"{p}_c": F.count_if(long)},
        keys=("space_id",), rooms=True,
        entity={**_us(), f"{p}_us": _weighted(f"{p}_m", *types), f"{p}_rows": _weighted(f"{p}_c", *types)},
        output={
            "total_seconds": us_to("s", F.col("us")), "long_seconds": us_to("s", F.col(f"{p}_us")),
            "long_pct": ratio(f"{p}_us", "us"),
        },
        present=F.col(f"{p}_rows") > 0,
    )


def evening_departure(start: str = "17:00", end: str = "20:00") -> Metric:
    p = "evening_departure"
    inside = F.col("last_tod").between(F.lit(clock_us(start)), F.lit(clock_us(end)))
    return Metric(
        p, {"last_tod": F.max(tod_us("end_time"))}, keys=("day",), day={"last_tod": F.max("last_tod")},
        entity={**_day_rows(), f"{p}_ok": F.count_if(inside)},
        output={"total_day_count": F.col("day_rows"), "evening_pct": ratio(f"{p}_ok", "day_rows")},
    )


def rooms_with_office_days(lo: int = 3, hi: int = 5, min_minutes: float = 10, whole_minutes: bool = True) -> Metric:
    p = "rooms_with_office_days"
    measures, room, enough = _room_minutes(p, min_minutes, whole_minutes)
    return Metric(
        p, measures, keys=("day", "space_id"), rooms=True,
        room={**room, f"{p}_fac": F.max(F.coalesce("faculty_rows", F.lit(0)))},
        day={
            f"{p}_rooms": F.count(F.when(enough, F.col("space_id"))),
            f"{p}_office": F.max(F.when(enough & (F.col(f"{p}_fac") > 0), 1).otherwise(0)),
        },
        entity={
            **_day_rows(),
            f"{p}_ok": F.count_if(F.col(f"{p}_rooms").between(lo, hi) & (F.col(f"{p}_office") == 1)),
        },
        output={"qualified_days": F.col(f"{p}_ok"), "total_day_count": F.col("day_rows")},
        present=F.col(f"{p}_ok") > 0,
    )


def late_nights_count(at: str = "20:30") -> Metric:
    p = "late_nights_count"
    return Metric(
        p, {"last_end": F.max("end_time")}, keys=("day",), day={"last_end": F.max("last_end")},
        entity={f"{p}_late": F.count_if(at_or_after("last_end", at))},
        output={"late_days": F.col(f"{p}_late")},
        present=F.col(f"{p}_late") > 0,
    )


def max_weekday_share() -> Metric:
    p = "max_weekday_share"
    per_day = {f"{p}_{d}": F.sum(F.when(F.weekday("day") == d, F.col("n")).otherwise(0)) for d in range(7)}
    return Metric(
        p, {**_n()}, keys=("day",), entity={**_sum_n(), **per_day},
        output={"max_day_pct": ratio(F.greatest(*per_day), "n")},
    )


def lab_weekday_share(types=(LAB,), days=MONDAY_TO_FRIDAY) -> Metric:
    p = "lab_weekday_share"
    return Metric(
        p, {f"{p}_m": F.count_if(on_days("start_time", days))}, keys=("space_id",), rooms=True,
        entity={f"{p}_n": F.sum(f"{p}_m"), f"{p}_lab": _weighted(f"{p}_m", *types)},
        output={"lab_pct": ratio(f"{p}_lab", f"{p}_n")},
        present=F.col(f"{p}_n") > 0,
    )


def office_and_lab_days(lo: int = 3, hi: int = 5, min_minutes: float = 10, types=DESK_TYPES, min_types: int = 2, whole_minutes: bool = False) -> Metric:
    p = "office_and_lab_days"
    measures, room, enough = _room_minutes(p, min_minutes, whole_minutes)
    seen = {f"{p}_t{i}": F.max(type_rows(t)) for i, t in enumerate(types)}
    kinds = sum(
        (F.max(F.when(enough & (F.col(c) > 0), 1).otherwise(0)) for c in seen), F.lit(0)
    )
    return Metric(
        p, measures, keys=("day", "space_id"), rooms=True, room={**room, **seen},
        day={f"{p}_rooms": F.count(F.when(enough, F.col("space_id"))), f"{p}_kinds": kinds},
        entity={
            **_day_rows(),
            f"{p}_ok": F.count_if(F.col(f"{p}_rooms").between(lo, hi) & (F.col(f"{p}_kinds") >= min_types)),
        },
        output={"pct": ratio(f"{p}_ok", "day_rows")},
    )


def faculty_visits(min_minutes: float = 10) -> Metric:
    p = "faculty_visits"
    fac = F.coalesce("faculty_rows", F.lit(0))
    long = us_to("min", F.col("us")) >= F.lit(float(min_minutes))
    return Metric(
        p, {**_n(), f"{p}_m": F.count_if(long)}, keys=("day", "space_id"), rooms=True,
        entity={
            **_sum_n(), f"{p}_hit": F.sum(F.col(f"{p}_m") * fac),
            f"{p}_days": distinct_where((F.col(f"{p}_m") > 0) & (fac > 0), "day"),
        },
        output={"faculty_pct": ratio(f"{p}_hit", "n"), "faculty_days": F.col(f"{p}_days")},
        present=F.col(f"{p}_hit") > 0,
    )


def ends_in_window_days(start: str = "17:30", end: str = "19:30") -> Metric:
    p = "ends_in_window_days"
    return Metric(
        p, {f"{p}_m": F.count_if(in_clock("end_time", start, end))}, keys=("day",),
        day={f"{p}_m": F.sum(f"{p}_m")},
        entity={**_day_rows(), f"{p}_ok": F.count_if(F.col(f"{p}_m") > 0)},
        output={"percentage": ratio(f"{p}_ok", "day_rows")},
    )


def lab_avg_duration_days(lo: float = 0.5, hi: float = 1.5, types=(LAB,)) -> Metric:
    p = "lab_avg_duration_days"
    avg = F.col(f"{p}_us") / F.lit(1e6) / F.col(f"{p}_n") / F.lit(3600.0)
    inside = (F.col(f"{p}_n") > 0) & F.when(F.col(f"{p}_n") > 0, avg).between(F.lit(float(lo)), F.lit(float(hi)))
    return Metric(
        p, {**_n(), **_us()}, keys=("day", "space_id"), rooms=True,
        day={f"{p}_us": _weighted("us", *types), f"{p}_n": _weighted("n", *types)},
        entity={**_day_rows(), f"{p}_ok": F.count_if(inside)},
        output={"percentage": ratio(f"{p}_ok", "day_rows")},
        present=F.col(f"{p}_ok") > 0,
    )


def device_features() -> Metric:
    return Metric(
        "device_features",
        {**_n(), **_us(), "first_start": F.min("start_time"), "last_end": F.max("end_time")},
        keys=("day", "sensor_id"),
        entity={
            **_sum_n(), **_us(), **_days(), "aps": F.count_distinct("sensor_id"),
            "first_start": F.min("first_start"), "last_end": F.max("last_end"),
        },
        output={
            "mean_interval": F.col("us") / F.lit(1e6) / F.col("n"), "total_conn": F.col("n"),
            "num_days": F.col("days"), "start_date": F.col("first_start"),
            "end_date": F.col("last_end"), "unique_ap": F.col("aps"),
        },
    )
