"""Durations, clock windows and epoch-aligned slots on TIMESTAMP_NTZ columns.

Clock comparisons use whole microseconds since midnight (BIGINT), so they stay
inside code generation; Spark 4.1 has no usable TIME type.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONDAY_TO_FRIDAY = (0, 1, 2, 3, 4)
SUNDAY_TO_THURSDAY = (6, 0, 1, 2, 3)
INTERVALS = (900, 1800, 3600, 7200, 14400, 28800, 86400)
_US = 1_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value) -> Column:
    """A TIMESTAMP_NTZ literal from text/datetime, or the column itself."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def span_us(start: Column | str, end: Column | str) -> Column:
    """Exact length in microseconds (BIGINT)."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def seconds(start, end) -> Column:
    return span_us(start, end) / F.lit(1e6)


def minutes(start, end) -> Column:
    return seconds(start, end) / F.lit(60.0)


def hours(start, end) -> Column:
    return seconds(start, end) / F.lit(3600.0)


def whole(unit: str, start, end) -> Column:
    """Length truncated to whole units (9:59 is 9 minutes)."""
    return F.timestamp_diff(unit, col(start), col(end))


def us_to(unit: str, us: Column) -> Column:
    """Fractional seconds / minutes / hours of a microsecond sum."""
    sec = us / F.lit(1e6)
    return {"s": sec, "min": sec / F.lit(60.0), "h": sec / F.lit(3600.0)}[unit]


def day(c: Column | str) -> Column:
    return F.to_date(col(c))


def tod_us(c: Column | str) -> Column:
    """Microseconds since midnight."""
    return span_us(F.to_date(col(c)).cast("timestamp_ntz"), c)


def clock_us(clock: str) -> int:
    """'22:00' or '20:30:00' as microseconds since midnight."""
    h, m, s = (clock.split(":") + ["0", "0"])[:3]
    return (int(h) * 3600 + int(m) * 60 + int(s)) * _US


def at_or_after(c, clock: str) -> Column:
    return tod_us(c) >= F.lit(clock_us(clock))


def at_or_before(c, clock: str) -> Column:
    return tod_us(c) <= F.lit(clock_us(clock))


def in_clock(c, lo: str, hi: str) -> Column:
    """Inclusive clock window."""
    return tod_us(c).between(F.lit(clock_us(lo)), F.lit(clock_us(hi)))


def on_days(c, days=MONDAY_TO_FRIDAY) -> Column:
    """Day-of-week test, 0 = Monday."""
    return F.weekday(col(c)).isin(*days)


def hour_bin(c, width: int = 2) -> Column:
    return F.floor(F.hour(col(c)) / F.lit(width))


def epoch_us(c: Column | str) -> Column:
    return span_us(ts("1970-01-01 00:00:00"), c)


def slot(c: Column | str, width_s: int) -> Column:
    """Number of the epoch-aligned slot holding ``c`` (floor)."""
    us, w = epoch_us(c), F.lit(width_s * _US).cast("long")
    return ((us - F.pmod(us, w)) / w).cast("long")


def slot_before(c: Column | str, width_s: int) -> Column:
    """Number of the last slot that begins strictly before ``c``."""
    us, w = epoch_us(c) - F.lit(1), F.lit(width_s * _US).cast("long")
    return ((us - F.pmod(us, w)) / w).cast("long")


def slot_start(n: Column | str, width_s: int) -> Column:
    """Timestamp at which slot ``n`` begins."""
    return F.timestamp_add(
        "SECOND", col(n) * F.lit(width_s).cast("long"), ts("1970-01-01 00:00:00")
    )


def align_down(c: Column | str, width_s: int) -> Column:
    return slot_start(slot(c, width_s), width_s)


def check_interval(interval_s: int) -> int:
    if interval_s not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}, got {interval_s}")
    return interval_s
