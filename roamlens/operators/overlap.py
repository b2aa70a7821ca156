"""Interval-overlap joins over dyadic cells.

Two intervals that overlap do so from the later of their two starts on. So
each overlapping pair is found exactly once by looking for a *start point* of
one side inside an *interval* of the other. Time is cut into slots; an interval
becomes the few aligned cells of 1, 2, 4, 8 … slots that cover it (two per size
at most, however long it is), a point probes the cells above its slot, of the
sizes that intervals at its place have. Both meet in one equi join on
(place, cell), with the exact test kept as residual.

A cell with many points or many intervals is cut on both sides: its points and
its intervals are dealt out to salted parts, each part of points meets each part
of intervals, and no pair is lost or doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roamlens.functions.times import slot
from roamlens.functions.values import overlaps
from roamlens.session import BROADCAST_ROWS

BUCKET_S = 3600
# Points or intervals of one cell that one task handles.
HOT_ROWS = 50_000
# A cell is one number: index, direction of the search, size as a power of two.
_SIZE_BITS = 6
_STEP = 1 << (_SIZE_BITS + 1)
# Intervals of up to so many slots are kept as slots.
_SHORT = 4


def _cell(index: Column, size: Column | int, way: int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return index * _STEP + F.lit(way << _SIZE_BITS).cast("long") + size.cast("long")


def dyadic_cells(first: Column, last: Column, way: int = 0) -> Column:
    """Cells that cover the slots ``first`` … ``last`` exactly; none if last < first.

    At size 2^k the covered blocks run from ceil(first / 2^k) to the one before
    floor((last + 1) / 2^k); a block at either end whose neighbour isn't covered
    at the next size is a cell. A few slots stay as they are.
    """
    none = F.array().cast("array<bigint>")

    def ends(k: Column) -> Column:
        lo, hi = -F.call_function("shiftright", -first, k), F.call_function("shiftright", last + 1, k)
        left = F.when((lo < hi) & (lo % 2 != 0), F.array(_cell(lo, k, way))).otherwise(none)
        right = F.when((lo < hi) & (hi % 2 != 0), F.array(_cell(hi - 1, k, way))).otherwise(none)
        return F.concat(left, right)

    few = F.sequence(_cell(first, 0, way), _cell(last, 0, way), F.lit(_STEP).cast("long"))
    many = F.flatten(F.transform(F.sequence(F.lit(0), _top(first, last)), ends))
    return F.when(last < first, none).when(last - first < _SHORT, few).otherwise(many)


def _top(first: Column, last: Column) -> Column:
    """Largest size, as a power of two, in the cover of some slots; -1 if there are none."""
    n = last - first + 1
    return F.when(n <= 0, -1).when(n <= _SHORT, 0).otherwise(F.floor(F.log2(n.cast("double")))).cast("int")


def cells_above(slot_no: Column, top: Column, largest: int, way: int = 0) -> Column:
    """The cells that hold a slot, of all sizes up to ``top`` (none below 0, ``largest`` at most)."""
    every = F.array(*[_cell(F.shiftright(slot_no, k), k, way) for k in range(largest + 1)])
    return F.slice(every, 1, F.greatest(top + 1, F.lit(0)))


class _Side:
    """One side of a join: rows as a struct, their first and last slot."""

    def __init__(self, df: DataFrame, name: str, place: list[str], width_s: int):
        self.name, self.place = name, place
        first, last = slot("start_time", width_s), slot("end_time", width_s)
        self.rows = df.select(
            *[F.col(c) for c in place], F.struct(*[F.col(c).alias(c) for c in df.columns]).alias(name),
            first.alias("_b0"), F.coalesce(last, first - 1).alias("_b1"),
        )

    def measured(self, way: int) -> DataFrame:
        """(place, _n, _t0, _t1): rows, and the largest size of the intervals searched in ``way``."""
        top = _top(F.col("_b0"), F.col("_b1"))
        return self.rows.groupBy(*self.place).agg(
            F.count("*").alias("_n"), *[F.max(top if k == way else F.lit(-1)).alias(f"_t{k}") for k in (0, 1)]
        )

    def keyed(self, sizes: DataFrame, largest: int, point: int | None, span: int | None) -> DataFrame:
        """One row per cell that a row probes with its start or covers with its interval."""
        d, cells = self.rows, []
        if point is not None:
            d = d.join(sizes, self.place)
            cells.append(cells_above(F.col("_b0"), F.col(f"_t{point}"), largest, point))
        if span is not None:
            cells.append(dyadic_cells(F.col("_b0"), F.col("_b1"), span))
        return d.select(*self.place, self.name, F.explode(F.concat(*cells)).alias("_cell"))


def _way() -> Column:
    return F.col("_cell").bitwiseAND(F.lit(1 << _SIZE_BITS)) != 0


def _sizes(sides: list[tuple[_Side, int]]) -> tuple[DataFrame, int, bool]:
    """Per place the largest size of either direction; the largest of all; whether
    a place has enough rows for a hot cell. Few places come back as local rows."""
    measured = None
    for side, way in sides:
        m = side.measured(way)
        measured = m if measured is None else measured.unionByName(m)
    place = sides[0][0].place
    per_place = measured.groupBy(*place).agg(F.sum("_n").alias("_n"), F.max("_t0").alias("_t0"), F.max("_t1").alias("_t1"))
    found = per_place.limit(BROADCAST_ROWS + 1).collect()
    if len(found) > BROADCAST_ROWS:
        top, most = per_place.agg(F.max(F.greatest("_t0", "_t1")), F.max("_n")).first()
        return per_place.drop("_n"), top, most
    top = max((max(r._t0, r._t1) for r in found), default=0)
    local = per_place.sparkSession.createDataFrame(found, per_place.schema).drop("_n")
    return F.broadcast(local), max(top, 0), max((r._n for r in found), default=0)


def _hot_cells(l: DataFrame, r: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """(keys, _l, _r): into how many parts either side of a crowded cell is cut."""
    counts = [d.groupBy(*keys).agg(F.count("*").alias(f"_{n}")) for d, n in ((l, "l"), (r, "r"))]
    parts = lambda c: F.ceil(F.col(c) / F.lit(hot_rows)).cast("int").alias(c)
    return counts[0].join(counts[1], keys).where(F.greatest("_l", "_r") > hot_rows).select(*keys, parts("_l"), parts("_r"))


def _salted(df: DataFrame, side: str, keys: list[str], hot: DataFrame) -> DataFrame:
    """A row of a hot cell goes to one part of its own side and to every part of the other."""
    own, other = (F.coalesce(c, F.lit(1)) for c in (("_l", "_r") if side == "l" else ("_r", "_l")))
    mine = F.pmod(F.xxhash64(side), own).cast("int")
    salt = F.transform(F.sequence(F.lit(0), other - 1), lambda k: F.struct(
        *[c.cast("int").alias(n) for c, n in ((mine, "x"), (k, "y"))] if side == "l" else [c.cast("int").alias(n) for c, n in ((k, "x"), (mine, "y"))]
    ))
    return df.join(hot, keys, "left").withColumn("_salt", F.explode(salt)).drop("_l", "_r")


def _met(l: DataFrame, r: DataFrame, keys: list[str], crowded: bool, hot_rows: int, test: Column) -> DataFrame:
    """Rows of both sides joined on their cells; salted only where a cell is hot."""
    if crowded:
        hot = _hot_cells(l, r, keys, hot_rows)
        if not hot.isEmpty():
            return _salted(l, "l", keys, hot).join(_salted(r, "r", keys, hot), [*keys, "_salt"]).where(test)
    return l.join(r, keys).where(test)


def overlap_join(
    left: DataFrame, right: DataFrame, place: str | list[str], inclusive: bool = False,
    bucket_s: int = BUCKET_S, hot_rows: int = HOT_ROWS, extra=None,
) -> DataFrame:
    """All pairs (struct columns ``l``, ``r``) at the same place whose
    [start_time, end_time] overlap; ``extra`` is a further test on the pair.

    Direction 0 finds left starts in right intervals, direction 1 right starts,
    strictly after the left ones, in left intervals.
    """
    place = [place] if isinstance(place, str) else list(place)
    ls, rs = _Side(left, "l", place, bucket_s), _Side(right, "r", place, bucket_s)
    sizes, largest, most = _sizes([(rs, 0), (ls, 1)])
    later = F.when(_way(), F.col("r.start_time") > F.col("l.start_time")).otherwise(
        F.col("l.start_time") >= F.col("r.start_time")
    )
    test = later & overlaps("l.start_time", "l.end_time", "r.start_time", "r.end_time", inclusive)
    if extra is not None:
        test = test & extra
    l, r = ls.keyed(sizes, largest, 0, 1), rs.keyed(sizes, largest, 1, 0)
    return _met(l, r, [*place, "_cell"], most > hot_rows, hot_rows, test).select("l", "r")


def overlap_self_join(
    df: DataFrame, place: str | list[str], differ: str, inclusive: bool = False,
    bucket_s: int = BUCKET_S, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Overlapping pairs of one table, each unordered pair of rows once.

    Only rows that differ in the column ``differ`` are paired. ``l`` starts in
    ``r``: it is the later of the two, or at equal starts the one with the greater
    value of ``differ``. One direction of the search is enough.
    """
    place = [place] if isinstance(place, str) else list(place)
    ls, rs = _Side(df, "l", place, bucket_s), _Side(df, "r", place, bucket_s)
    sizes, largest, most = _sizes([(rs, 0)])
    a, b = F.col("l.start_time"), F.col("r.start_time")
    mine, other = F.col(f"l.{differ}"), F.col(f"r.{differ}")
    later = (mine != other) & ((a > b) | ((a == b) & (mine > other)))
    test = later & overlaps("l.start_time", "l.end_time", "r.start_time", "r.end_time", inclusive)
    l, r = ls.keyed(sizes, largest, 0, None), rs.keyed(sizes, largest, None, 0)
    return _met(l, r, [*place, "_cell"], most > hot_rows, hot_rows, test).select("l", "r")


def overlap_left_join(
    left: DataFrame, right: DataFrame, place: str | list[str], key: list[str], inclusive: bool = True,
    bucket_s: int = BUCKET_S, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """As :func:`overlap_join`, and each left row without a partner once with a
    NULL ``r``. ``key`` names left columns that are unique together."""
    pairs = overlap_join(left, right, place, inclusive, bucket_s, hot_rows)
    matched = pairs.select(*[F.col(f"l.{c}").alias(c) for c in key]).distinct()
    alone = left.join(matched, key, "left_anti").select(
        F.struct(*[F.col(c).alias(c) for c in left.columns]).alias("l"),
        F.lit(None).cast(pairs.schema["r"].dataType).alias("r"),
    )
    return pairs.unionByName(alone)
