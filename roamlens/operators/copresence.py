"""Metrics over overlapping sessions: co-paired devices and shared rooms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roamlens.functions.values import ratio
from roamlens.operators.device_blocks import GROUP_DEVICES, TOGETHER, Block, Side, by_blocks
from roamlens.operators.dims import Dims
from roamlens.operators.ordered import top_one
from roamlens.operators.overlap import BUCKET_S, overlap_join
from roamlens.operators.scope import KEY, scope_to
from roamlens.session import sized_broadcast

# Coverage regions that are not a group's rooms (fixed values).
CLASSROOMS = ("NorthClassroom", "SouthClassroom", "InnerClassroom")


def _of_role(role: str, spaces: tuple, totals: tuple) -> np.ndarray:
    """Whether the target, the first of each two, has fewer (laptop) or more (phone) of either."""
    less = {"laptop": np.less, "phone": np.greater}[role]
    return less(*spaces) | less(*totals)


def _counts(block: Block) -> np.ndarray:
    """By pair of devices: overlapping session pairs."""
    n = np.zeros(block.shape[0] * block.shape[1], np.int64)
    for p in range(len(block.places)):
        for met in block.pairs(p):
            np.add.at(n, met.cells(), 1)
    return n


def _details(block: Block, n: np.ndarray | None, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """By pair of devices: places where they overlap, overlap time times the place's weight.

    Of the given ``pairs`` only, in their order, if there are any; else of all, whose session pairs are counted in ``n``.
    """
    size = block.shape[0] * block.shape[1]
    nth = None
    if pairs is not None:
        nth = np.full(size, -1, np.int32)
        nth[pairs] = np.arange(len(pairs))
        size = len(pairs)
    us, places, seen = (np.zeros(size, t) for t in (np.int64, np.int32, np.int32))
    for p in range(len(block.places)) if size else []:
        for met in block.pairs(p):
            pair = met.cells()
            if nth is None:
                np.add.at(n, pair, 1)
            else:
                pair = nth.take(pair)
                some = np.flatnonzero(pair >= 0)
                pair, met = pair[some], met.among(some)
            np.add.at(us, pair, met.shared() * block.weights[p])
            fresh = pair[seen.take(pair) <= p]
            places[fresh] += 1  # once, however often a pair is in the list
            seen[fresh] = p + 1
    return places, us


def _ways(block: Block) -> list[tuple[Side, Side, bool]]:
    """(side of the targets, side of the others, swapped)."""
    return [(block.a, block.b, False)] + [(block.b, block.a, True)] * block.mirrored


def copair_pairs(
    sessions: DataFrame, entities: DataFrame | None = None, role: str = "laptop",
    min_share: float | None = None, group_devices: int = GROUP_DEVICES,
) -> DataFrame:
    """Device pairs seen together at a space, with the target's share.

    role 'laptop' keeps partners with more spaces or more sessions than the
    target, 'phone' with fewer. Every pair that ever met is
    listed; ``min_share`` keeps those from a share on (the documented one is 0.8).
    """
    stats = (
        sessions.groupBy(KEY, "space_id").agg(F.count("*").alias("n"))
        .groupBy(KEY).agg(F.sum("n").alias("total"), F.count("space_id").alias("spaces"))
    )

    def rows(target: Side, other: Side, t: np.ndarray, o: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the pairs of a target and another device are listed."""
        (total, spaces), (others_total, others_spaces) = target.facts[t].T, other.facts[o].T
        kept = _of_role(role, (spaces, others_spaces), (total, others_total))
        return kept if min_share is None else kept & (n / total >= min_share)

    def near(block: Block, n: np.ndarray) -> np.ndarray:
        """Pairs that may have the share, told by a number a little below it."""
        by_pair, found = n.reshape(block.shape), []
        for at in range(0, block.shape[0], 256):
            part = by_pair[at : at + 256]
            enough = part >= np.floor(block.a.facts[at : at + 256, :1] * min_share) - 1
            if block.mirrored:
                enough |= part >= np.floor(block.b.facts[:, 0] * min_share) - 1
            found.append(np.flatnonzero(enough & (part > 0)) + at * block.shape[1])
        return np.concatenate([*found, np.zeros(0, np.int64)])

    def fold(block: Block) -> Iterator[pa.RecordBatch]:
        if min_share is None:
            n = np.zeros(block.shape[0] * block.shape[1], np.int64)
            places, us = _details(block, n)
            met = np.flatnonzero(n)
        else:  # most pairs are told by their counts
            n = _counts(block)
            met = near(block, n)
            listed = np.zeros(len(met), bool)
            for at in range(0, len(met), TOGETHER):
                pair = met[at : at + TOGETHER]
                first, second = np.divmod(pair, block.shape[1])
                for target, other, swapped in _ways(block):
                    t, o = (second, first) if swapped else (first, second)
                    listed[at : at + TOGETHER] |= rows(target, other, t, o, n[pair])
            met = met[listed]
            n = n[met]
            places, us = _details(block, None, met)
        for at in range(0, len(met), TOGETHER):
            pair = met[at : at + TOGETHER]
            own = pair if min_share is None else slice(at, at + len(pair))
            first, second = np.divmod(pair, block.shape[1])
            for target, other, swapped in _ways(block):
                t, o = (second, first) if swapped else (first, second)
                kept = rows(target, other, t, o, n[own])
                columns = (n[own], n[own] / target.facts[t, 0], places[own].astype(np.int64), us[own] / 1e6)
                yield pa.RecordBatch.from_arrays(
                    [target.names.take(pa.array(t[kept])), other.names.take(pa.array(o[kept])), *[pa.array(c[kept]) for c in columns]],
                    ["target_user", "other_user", "overlap_count", "overlap_share", "other_space_count", "overlap_seconds"],
                )

    return by_blocks(
        sessions, entities, "space_id", stats, fold,
        "target_user STRING, other_user STRING, overlap_count BIGINT, overlap_share DOUBLE, other_space_count BIGINT, overlap_seconds DOUBLE",
        group_devices,
    )


def copair_group(
    sessions: DataFrame, dims: Dims, entities: DataFrame | None = None, min_share: float = 0.8,
    exclude=CLASSROOMS, group_devices: int = GROUP_DEVICES,
) -> DataFrame:
    """Most frequent region in overlaps with partners covering enough of the
    device's own time.

    A sensor weighs as many times as it has regions. Pairs are looked at once
    for the time of two devices, and once more for the sensors of those that share
    enough; regions are joined to sums per (target, sensor).
    """
    regions = dims.regions(exclude)
    fan = regions.groupBy("sensor_id").agg(F.count("*").alias("weight"))
    own = sessions.groupBy(KEY).agg(
        F.sum(F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time"))).alias("own_us")
    ).where("own_us IS NOT NULL")

    def fold(block: Block) -> Iterator[pa.RecordBatch]:
        us = np.zeros(block.shape[0] * block.shape[1], np.int64)
        for p in range(len(block.places)):
            for met in block.pairs(p):
                np.add.at(us, met.cells(), met.shared() * block.weights[p])
        us = us.reshape(block.shape)
        enough = np.zeros(block.shape, np.uint8)  # 1: for the device of a, 2: for that of b
        for target, _, swapped in _ways(block):
            own_us = target.facts[:, 0].astype(np.float64)
            own_us = np.where(own_us == 0, np.nan, own_us)
            for at in range(0, len(us), 256):
                share = us[at : at + 256] / (own_us if swapped else own_us[at : at + 256, None])
                enough[at : at + 256] |= (share >= min_share).astype(np.uint8) << swapped
        enough = enough.reshape(-1)
        for p in range(len(block.places)) if enough.any() else []:
            freq = [np.zeros(len(target.names), np.int64) for target, _, _ in _ways(block)]
            for met in block.pairs(p):
                of_pair = enough.take(met.cells())
                some = np.flatnonzero(of_pair)
                of_pair = of_pair[some]
                for f, bit, device in zip(freq, (1, 2), met.among(some).devices()):
                    np.add.at(f, device[of_pair & bit > 0], 1)
            for f, (target, _, _) in zip(freq, _ways(block)):
                found = pa.array(np.flatnonzero(f))
                place = block.places.take(pa.array(np.full(len(found), p)))
                yield pa.RecordBatch.from_arrays([target.names.take(found), place, pa.array(f[f > 0])], [KEY, "sensor_id", "pairs"])

    weighed = sessions.join(sized_broadcast(fan), "sensor_id")
    strong = by_blocks(weighed, entities, "sensor_id", own, fold, f"{KEY} STRING, sensor_id STRING, pairs BIGINT", group_devices)
    per_sensor = strong.groupBy(KEY, "sensor_id").agg(F.sum("pairs").alias("pairs"))
    freq = per_sensor.join(regions, "sensor_id").groupBy(KEY, "space_name").agg(F.sum("pairs").alias("freq"))
    return top_one(freq, [KEY], F.col("freq"), "space_name")


def shared_rooms(sessions: DataFrame, dims: Dims, entities: DataFrame | None = None, min_connections: int = 1, bucket_s: int = BUCKET_S) -> DataFrame:
    """Share of (session, occupancy interval) rows with other devices there.

    Inclusive overlap, fan-out kept; a session without any interval counts as
    one row that is not shared.
    """
    own = scope_to(sessions, entities).select(KEY, "space_id", "start_time", "end_time")
    # equal sessions are told apart by how often they occur
    own = own.groupBy(*own.columns).agg(F.count("*").alias("copies"))
    occ = dims.space_occupancy.select("space_id", "start_time", "end_time", "number_connections")
    per_session = (
        overlap_join(own, occ, "space_id", inclusive=True, bucket_s=bucket_s)
        .groupBy("l").agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("r.number_connections") >= min_connections).alias("shared"),
        )
        .select(f"l.{KEY}", "l.space_id", "l.start_time", "l.end_time", "rows", "shared")
    )
    rows = F.coalesce("rows", F.lit(1)) * F.col("copies")
    shared = F.coalesce("shared", F.lit(0)) * F.col("copies")
    return (
        own.join(per_session, [KEY, "space_id", "start_time", "end_time"], "left")
        .groupBy(KEY).agg(F.sum(rows).alias("total_count"), F.sum(shared).alias("shared_count"))
        .withColumn("shared_pct", ratio("shared_count", "total_count"))
    )


def concurrent_rooms(sessions: DataFrame, dims: Dims, entities: DataFrame | None = None, min_connections: int = 2, bucket_s: int = BUCKET_S) -> DataFrame:
    """Rows of strict overlap with occupancy intervals, and those of at least
    ``min_connections`` devices."""
    own = scope_to(sessions, entities).select(KEY, "space_id", "start_time", "end_time")
    occ = dims.space_occupancy.select("space_id", "start_time", "end_time", "number_connections")
    return (
        overlap_join(own, occ, "space_id", bucket_s=bucket_s)
        .groupBy(F.col(f"l.{KEY}").alias(KEY)).agg(
            F.count("*").alias("total_count"),
            F.count_if(F.col("r.number_connections") >= min_connections).alias("shared_count"),
        )
    )
