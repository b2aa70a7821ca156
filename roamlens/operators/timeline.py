"""Regular time series per space: gap filling, splits, windows, scaling.

Series are (space_id, ds, y). Ordered steps look a bounded number of slots
back, so they run in blocks with a halo instead of one window per space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roamlens.functions.times import slot, slot_start, ts
from roamlens.functions.values import ap_building, ap_contains
from roamlens.operators.ordered import blocked_row_number, with_halo

BLOCK_SLOTS = 4096
QUIET_FROM, QUIET_UNTIL = 22, 8  # hours with nobody expected


def as_series(bins: DataFrame) -> DataFrame:
    return bins.select("space_id", F.col("interval_begin_time").alias("ds"), F.col("number_connections").cast("double").alias("y"))


def counts_by_level(counts: DataFrame, level: str, location: str, floor_prefix: str = "314") -> DataFrame:
    """(ds, y) of an access point, a floor or a building from
    (interval_begin_time, ap, count)."""
    keep = {
        "ap": F.col("ap") == location,
        "floor": ap_contains("ap", floor_prefix + str(location)),
        "building": ap_building("ap") == location,
    }[level]
    return counts.where(keep).groupBy(F.col("interval_begin_time").alias("ds")).agg(F.sum("count").alias("y"))


def quiet_hour(ds: Column | str) -> Column:
    h = F.hour(ds)
    return (h >= QUIET_FROM) | (h < QUIET_UNTIL)


def _grid(series: DataFrame, interval_s: int, whole_days: bool) -> DataFrame:
    lo, hi = F.min("ds"), F.max("ds")
    if whole_days:
        lo = F.to_date(lo).cast("timestamp_ntz")
        hi = F.timestamp_add("DAY", F.lit(1), F.to_date(hi).cast("timestamp_ntz"))
    ends = series.groupBy("space_id").agg(slot(lo, interval_s).alias("_lo"), slot(hi, interval_s).alias("_hi"))
    return ends.select("space_id", F.explode(F.sequence("_lo", "_hi")).alias("slot"))


def forward_fill(df: DataFrame, value: str, number: str, limit: int, keys=("space_id",), block: int = BLOCK_SLOTS) -> DataFrame:
    """Last value at most ``limit`` slots back; ``df`` has every slot."""
    w = Window.partitionBy(*keys, "_block").orderBy(number).rowsBetween(-limit, 0)
    return (
        with_halo(df, number, limit, block)
        .withColumn(value, F.last(value, ignorenulls=True).over(w))
        .where("_home").drop("_home", "_block")
    )


def fill_timeline(series: DataFrame, interval_s: int, mode: str = "bounded", limit: int | None = None,
                  whole_days: bool = False, static_devices: bool = False, drop_gaps: bool = True) -> DataFrame:
    """Every slot from a space's first to last one.

    Empty slots of the quiet hours are 0. 'bounded' carries the last value
    forward for up to an hour and drops what stays empty; 'zero' fills with 0.
    ``whole_days`` runs from the first midnight to the midnight after the last
    day; ``static_devices`` takes one always-on device off positive counts.
    """
    have = series.select("space_id", slot("ds", interval_s).alias("slot"), F.col("y").cast("double").alias("y"))
    df = _grid(series, interval_s, whole_days).join(have, ["space_id", "slot"], "left")
    df = df.withColumn("ds", slot_start("slot", interval_s))
    df = df.withColumn("y", F.when(F.col("y").isNull() & quiet_hour("ds"), F.lit(0.0)).otherwise(F.col("y")))
    if mode == "zero":
        df = df.withColumn("y", F.coalesce("y", F.lit(0.0)))
    else:
        df = forward_fill(df, "y", "slot", max(1, 3600 // interval_s) if limit is None else limit)
    if static_devices:
        df = df.withColumn("y", F.when(F.col("y") > 0, F.col("y") - 1).otherwise(F.col("y")))
    if drop_gaps:
        df = df.where("y IS NOT NULL")
    return df.select("space_id", "ds", "y")


def time_split(series: DataFrame, interval_s: int, test: float = 0.1) -> DataFrame:
    """Adds ``is_train``: the first int(n * (1 - test)) rows of each space."""
    sizes = series.groupBy("space_id").agg(F.floor(F.count("*") * F.lit(1.0 - test)).alias("_cut"))
    block = F.floor(slot("ds", interval_s) / F.lit(BLOCK_SLOTS))
    return (
        blocked_row_number(series, ["space_id"], ["ds"], block, "_rn")
        .join(sizes, "space_id").withColumn("is_train", F.col("_rn") <= F.col("_cut")).drop("_rn", "_cut")
    )


def sequences(series: DataFrame, k: int, interval_s: int, features: list[str] = ("y",), block: int = BLOCK_SLOTS) -> DataFrame:
    """(space_id, ds, window, target): ``features`` of the k rows before ``ds``,
    oldest first, and the y at ``ds``. The series has every slot."""
    df = series.withColumn("slot", slot("ds", interval_s))
    w = Window.partitionBy("space_id", "_block").orderBy("slot").rowsBetween(-k, -1)
    row = F.array(*[F.col(c).cast("double") for c in features])
    return (
        with_halo(df, "slot", k, block)
        .withColumn("window", F.collect_list(row).over(w))
        .where(F.col("_home") & (F.size("window") == k))
        .select("space_id", "ds", "window", F.col("y").alias("target"))
    )


def scaling(series: DataFrame, how: str = "minmax", keys=("space_id",)) -> DataFrame:
    """(keys, shift, width) of the series: (min, max - min) or (mean, population std)."""
    if how == "minmax":
        stats = series.groupBy(*keys).agg(F.min("y").alias("shift"), (F.max("y") - F.min("y")).alias("width"))
    else:
        stats = series.groupBy(*keys).agg(F.avg("y").alias("shift"), F.stddev_pop("y").alias("width"))
    return stats.withColumn("width", F.when(F.col("width") == 0, F.lit(1.0)).otherwise(F.col("width")))


def apply_scaling(series: DataFrame, stats: DataFrame, keys=("space_id",), column: str = "y") -> DataFrame:
    return series.join(stats, list(keys)).withColumn(column, (F.col(column) - F.col("shift")) / F.col("width")).drop("shift", "width")


def undo_scaling(series: DataFrame, stats: DataFrame, keys=("space_id",), column: str = "y") -> DataFrame:
    return series.join(stats, list(keys)).withColumn(column, F.col(column) * F.col("width") + F.col("shift")).drop("shift", "width")


def binary_occupied(c: Column | str, above: float = 2) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > F.lit(above), 1).otherwise(0)


def history_or_forecast(known: DataFrame, forecast: DataFrame, begin, end=None) -> DataFrame:
    """Rows of [begin, end]: the known series inside its own time range, the
    forecast before and after it. ``known`` is (space_id, ds, y), ``forecast``
    (space_id, ds, yhat)."""
    end = begin if end is None else end
    span = known.groupBy("space_id").agg(F.min("ds").alias("_lo"), F.max("ds").alias("_hi"))
    asked = F.col("ds").between(ts(begin), ts(end))
    past = known.where(asked).select("space_id", "ds", F.col("y").cast("double").alias("y"), F.lit("history").alias("source"))
    ahead = (
        forecast.where(asked).join(span, "space_id")
        .where((F.col("ds") > F.col("_hi")) | (F.col("ds") < F.col("_lo")))
        .select("space_id", "ds", F.col("yhat").alias("y"), F.lit("forecast").alias("source"))
    )
    return past.unionByName(ahead)
