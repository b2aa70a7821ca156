"""Metric specifications and the chained aggregation that runs them.

A metric is a list of aggregates per level:

    sessions -> base grain (device, day, space, sensor)   ``measures``
             -> (device, day, space)                      ``room``
             -> (device, day)                             ``day``
             -> device                                    ``entity`` -> ``output``

Metrics with the same chain share one pass: their aggregates are merged into
one plan. The base grain is aggregated before anything is grouped by device,
so the rows of a very busy device are combined on the map side and spread over
its days and rooms; what then meets on the device key is at most one row per
(day, space, sensor).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from roamlens.functions.times import day, span_us
from roamlens.operators.dims import Dims
from roamlens.operators.scope import KEY, scope_to

CHAINS = ("entity", "day", "room")


@dataclass(frozen=True)
class Metric:
    name: str
    measures: dict[str, Column]
    entity: dict[str, Column]
    output: dict[str, Column]
    keys: tuple[str, ...] = ()
    day: dict[str, Column] | None = None
    room: dict[str, Column] | None = None
    rooms: bool = False
    only: Column | None = None  # session filter (single-metric runs and bundles with the same filter)
    present: Column | None = None
    params: dict = field(default_factory=dict)

    @property
    def chain(self) -> str:
        return "room" if self.room is not None else "day" if self.day is not None else "entity"


def session_columns(s: DataFrame) -> DataFrame:
    """Add ``day`` and ``us`` (exact length) to sessions."""
    return s.withColumns({"day": day("start_time"), "us": span_us("start_time", "end_time")})


def _merged(metrics: list[Metric], part: str) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for m in metrics:
        for name, c in (getattr(m, part) or {}).items():
            if name in out and str(out[name]) != str(c):
                raise ValueError(f"two metrics define '{name}' differently in {part}")
            out[name] = c
    return out


def _run_chain(chain: str, metrics: list[Metric], s: DataFrame, dims: Dims | None) -> DataFrame:
    base_keys = sorted({k for m in metrics for k in m.keys})
    if chain != "entity" and "day" not in base_keys:
        base_keys = ["day", *base_keys]
    if (chain == "room" or any(m.rooms for m in metrics)) and "space_id" not in base_keys:
        base_keys.append("space_id")

    def agg(df: DataFrame, keys: list[str], part: str) -> DataFrame:
        cols = _merged(metrics, part)
        return df.groupBy(KEY, *keys).agg(*[c.alias(n) for n, c in cols.items()])

    only = metrics[0].only
    if only is not None:
        s = s.where(only)
    df = agg(session_columns(s), base_keys, "measures")
    if any(m.rooms for m in metrics):
        df = df.join(dims.room_profile(), "space_id", "left")
    if chain != "entity":
        df = df.repartition(KEY)  # the levels below reuse this partitioning
    if chain == "room":
        df = agg(df, ["day", "space_id"], "room")
    if chain in ("room", "day"):
        df = agg(df, ["day"], "day")
    return agg(df, [], "entity")


def compute(metric: Metric, sessions: DataFrame, entities: DataFrame | None = None, dims: Dims | None = None) -> DataFrame:
    """One metric: key plus output columns, one row per entity."""
    df = _run_chain(metric.chain, [metric], scope_to(sessions, entities), dims)
    if metric.present is not None:
        df = df.where(metric.present)
    return df.select(KEY, *[c.alias(n) for n, c in metric.output.items()])


def metrics_bundle(sessions: DataFrame, metrics: list[Metric], entities: DataFrame | None = None, dims: Dims | None = None) -> DataFrame:
    """Many metrics in one pass per chain, columns named ``<metric>__<column>``.

    Entities a metric has no row for get NULL in its columns.
    """
    s = scope_to(sessions, entities)
    groups: dict[tuple, list[Metric]] = {}
    for m in metrics:
        groups.setdefault((m.chain, str(m.only)), []).append(m)
    parts = []
    for (chain, _), ms in groups.items():
        df = _run_chain(chain, ms, s, dims)
        cols = []
        for m in ms:
            for n, c in m.output.items():
                v = c if m.present is None else F.when(m.present, c)
                cols.append(v.alias(f"{m.name}__{n}"))
        parts.append(df.select(KEY, *cols))
    # every part is already partitioned by the key, so these joins do not shuffle
    return reduce(lambda a, b: a.join(b, KEY, "full_outer"), parts)


def qualify(metric_df: DataFrame, predicate: Column, columns: list[str] | None = None) -> DataFrame:
    """The entities whose metric passes a threshold."""
    df = metric_df.where(predicate)
    return df.select(KEY, *(columns if columns is not None else [c for c in df.columns if c != KEY]))
