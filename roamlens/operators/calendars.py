"""Calendar, cyclic, holiday and Fourier features of a timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roamlens.functions.times import epoch_us, on_days

# Academic quarters as month*100+day ranges (fixed values).
QUARTERS = {1: (924, 1214), 2: (102, 322), 3: (327, 614), 4: (624, 830)}
# Holiday ranges (fixed values).
HOLIDAYS = [
    ("Veterans Day", "2017-11-10", "2017-11-10"),
    ("Thanksgiving", "2017-11-23", "2017-11-24"),
    ("Winter Break", "2017-12-18", "2018-01-02"),
    ("Winter Admin Recess", "2017-12-25", "2018-01-02"),
    ("MLK Day", "2018-01-15", "2018-01-15"),
    ("Presidents Day", "2018-02-19", "2018-02-19"),
    ("Cesar Chavez Day", "2018-03-30", "2018-03-30"),
    ("Memorial Day", "2018-05-28", "2018-05-28"),
    ("Spring Break", "2018-03-26", "2018-03-30"),
]
# Seasonalities: name, period in days, Fourier order, condition (fixed values).
SEASONALITIES = [
    ("quarterly_pattern1", 70, 30, "quarter_1"),
    ("quarterly_pattern2", 84, 21, "quarter_2"),
    ("quarterly_pattern3", 90, 5, "quarter_3"),
    ("quarterly_pattern4", 60, 15, "quarter_4"),
    ("weekend_pattern", 7, 30, "is_weekend"),
    ("active_pattern", 1, 22, "is_active_hour"),
]
# The usual yearly, weekly and daily terms (fixed values).
ALWAYS = [("yearly", 365.25, 10, None), ("weekly", 7, 3, None), ("daily", 1, 4, None)]


def academic_quarter(ds: Column | str) -> Column:
    md = F.month(ds) * 100 + F.dayofmonth(ds)
    out = F.lit(0)
    for q, (lo, hi) in reversed(QUARTERS.items()):
        out = F.when(md.between(lo, hi), F.lit(q)).otherwise(out)
    return out


def calendar_features(df: DataFrame, ds: str = "ds") -> DataFrame:
    hour = F.hour(ds)
    df = df.withColumns({
        "quarter": academic_quarter(ds), "day": F.weekday(ds), "hour": hour, "month": F.month(ds),
        "is_weekend": F.when(on_days(ds, (5, 6)), 1).otherwise(0),
        "is_active_hour": F.when(hour.between(8, 22), 1).otherwise(0),
    })
    return df.withColumns({f"quarter_{q}": F.when(F.col("quarter") == q, 1).otherwise(0) for q in QUARTERS})


def cyclic_features(df: DataFrame, ds: str = "ds") -> DataFrame:
    hour = F.hour(ds) + F.minute(ds) / F.lit(60.0)
    a = F.lit(2 * math.pi) * F.col("hour") / F.lit(24.0)
    b = F.lit(2 * math.pi) * F.weekday(ds) / F.lit(7.0)
    return df.withColumn("hour", hour).withColumns({
        "hour_sin": F.sin(a), "hour_cos": F.cos(a), "dow_sin": F.sin(b), "dow_cos": F.cos(b), "holiday": F.lit(0),
    })


def holiday_days(spark: SparkSession, ranges=HOLIDAYS) -> DataFrame:
    """(holiday, ds DATE), one row per day of each range."""
    df = spark.createDataFrame(ranges, "holiday STRING, first STRING, last STRING")
    return df.select("holiday", F.explode(F.sequence(F.to_date("first"), F.to_date("last"))).alias("ds"))


def fourier(ds: Column | str, period_days: float, order: int) -> list[Column]:
    """sin, cos of the first ``order`` harmonics, time in days since the epoch."""
    t = epoch_us(ds) / F.lit(86400e6)
    out = []
    for n in range(1, order + 1):
        x = F.lit(2 * math.pi * n / period_days) * t
        out += [F.sin(x), F.cos(x)]
    return out


def fourier_features(df: DataFrame, period_days: float, order: int, condition: str | None = None, ds: str = "ds", name: str = "fourier") -> DataFrame:
    """One array column of the harmonics, zero where the condition is 0."""
    terms = fourier(ds, period_days, order)
    if condition is not None:
        terms = [c * F.col(condition) for c in terms]
    return df.withColumn(name, F.array(*terms))


def seasonal_design(df: DataFrame, seasonalities=None, holidays=HOLIDAYS, ds: str = "ds") -> DataFrame:
    """Adds ``x``: intercept, trend (years), holidays, Fourier terms."""
    df = calendar_features(df, ds)
    day = F.to_date(ds)
    parts = [F.lit(1.0), epoch_us(ds) / F.lit(86400e6 * 365.25) - F.lit(50.0)]
    for name in dict.fromkeys(n for n, _, _ in holidays):
        hit = [day.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for n, a, b in holidays if n == name]
        any_hit = hit[0]
        for h in hit[1:]:
            any_hit = any_hit | h
        parts.append(F.when(any_hit, 1.0).otherwise(0.0))
    for _, period, order, condition in ALWAYS + SEASONALITIES if seasonalities is None else seasonalities:
        terms = fourier(ds, period, order)
        parts += terms if condition is None else [c * F.col(condition) for c in terms]
    return df.withColumn("x", F.array(*parts))
