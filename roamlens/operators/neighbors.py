"""Exact k nearest neighbours without a cross join.

Training rows are dealt to blocks and test rows to chunks of bounded size.
Each (block, chunk) pair is one task-sized group that returns only the k best
of its block per test row; the k best of all blocks are then merged. Every
distance is looked at, as in a brute-force search, but no pair is emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from roamlens.operators.scope import KEY
from roamlens.session import durable

GROUP_ROWS = 20_000
# A search of every block has about so many blocks and chunks, as long as they keep within GROUP_ROWS.
MOST_BLOCKS = 32
# Distances looked at together.
TOGETHER = 1 << 20
# Rows of a search that are handed on together.
HANDED_ON = 1 << 14
# Cells of a search with pivots, however many rows there are; large cells are cut into blocks.
MOST_PIVOTS = 4096


def _best_of_block(k: int):
    def run(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        if train.empty or test.empty:
            return pd.DataFrame({"id": [], "dist": [], "other": [], "label": []})
        train = train.sort_values("id")
        a, b = np.stack(train["x"].to_numpy()), np.stack(test["x"].to_numpy())
        ids, labels = train["id"].to_numpy(dtype=object), train["label"].to_numpy()
        queries, parts = test["id"].to_numpy(dtype=object), []
        step, least = max(1, TOGETHER // (len(a) * max(a.shape[1], 1))), min(k, len(a))
        for i in range(0, len(b), step):
            q = b[i:i + step]
            d = np.sqrt(np.maximum(((q[:, None, :] - a[None, :, :]) ** 2).sum(axis=2), 0.0))
            # rows up to the k-th distance, ties with it too; the first k of them by distance and id
            # (a NaN comes last when sorting, and is kept only if fewer than k numbers are there)
            reach = np.partition(d, least - 1, axis=1)[:, least - 1]
            row, near = np.nonzero(~(d > reach[:, None]))
            order = np.lexsort((near, d[row, near], row))
            row, near = row[order], near[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < least
            row, near = row[kept], near[kept]
            parts.append((queries[i:i + step][row], d[row, near], ids[near], labels[near]))
        return pd.DataFrame(dict(zip(("id", "dist", "other", "label"), map(np.concatenate, zip(*parts)))))

    return run


def nearest(train: DataFrame, test: DataFrame, cols: list[str], k: int = 5, key: str = KEY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, neighbours ARRAY<STRUCT<dist, other, label>>), nearest first,
    equal distances by training id."""
    x = F.array(*[F.col(c).cast("double") for c in cols]).alias("x")
    a = train.select(F.col(key).alias("id"), F.col("label").cast("int").alias("label"), x)
    b = test.select(F.col(key).alias("id"), x)
    blocks, chunks = _dealt(a.count(), group_rows), _dealt(b.count(), group_rows)
    a = a.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    b = b.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    best = a.groupBy("block", "chunk").cogroup(b.groupBy("block", "chunk")).applyInPandas(
        _best_of_block(k), "id STRING, dist DOUBLE, other STRING, label INT"
    )
    return _merged(best, k, blocks, key)


def _dealt(rows: int, group_rows: int) -> int:
    """Groups of ``group_rows``, of up to GROUP_ROWS if there would be more than MOST_BLOCKS."""
    return max(1, math.ceil(rows / max(group_rows, min(GROUP_ROWS, math.ceil(rows / MOST_BLOCKS)))))


def _merged(best: DataFrame, k: int, blocks: int, key: str) -> DataFrame:
    """Merge in two levels, so no list is longer than k * sqrt(blocks)."""
    part = F.pmod(F.xxhash64("other"), F.lit(math.ceil(math.sqrt(blocks))))

    def k_best(c: Column) -> Column:
        return F.slice(F.array_sort(c), 1, k)

    level = best.groupBy("id", part.alias("_part")).agg(
        k_best(F.collect_list(F.struct("dist", "other", "label"))).alias("near")
    )
    return level.groupBy(F.col("id").alias(key)).agg(
        k_best(F.flatten(F.collect_list("near"))).alias("neighbours")
    )


@dataclass
class Cells:
    """Pivots and, per cell, the distances of its rows from its pivot, their number and blocks."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x**2).sum(axis=1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(axis=1)
        return np.sqrt(np.maximum(square, 0.0))

    def at_least(self, d: np.ndarray) -> np.ndarray:
        """No row of a cell is nearer than this to a point at distance d from its pivot,
        by the triangle inequality; a little less, for rounding."""
        bound = np.maximum(d - self.high, self.low - d)
        return bound - 1e-6 * (1.0 + d)


def _points(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.stack(batch.column(column).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty((0, 0))


def _cells_of(a: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their cell (nearest pivot) and the distance from its pivot."""
    cells = Cells(pivots, *[np.zeros(len(pivots))] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, max(1, TOGETHER // len(pivots))):
            d = cells.distances(_points(batch, "x"))
            cell = d.argmin(axis=1)
            columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "from_pivot"])

    return a.mapInArrow(run, "id STRING, label INT, x ARRAY<DOUBLE>, cell INT, from_pivot DOUBLE")


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _routed(b: DataFrame, cells: Cells, k: int, second: bool) -> DataFrame:
    """(id, x, cell, block): where a query is searched for.

    First in the nearest cells that hold k rows together; then, with ``reach`` the
    distance of the k-th row found, in every other cell that may hold a nearer one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, max(1, TOGETHER // len(cells.pivots))):
            d = cells.distances(_points(batch, "x"))
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(cells.rows[order], axis=1) - cells.rows[order]
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            if second:
                reach = batch.column("reach").to_numpy(zero_copy_only=False)
                wanted = ~first & (cells.at_least(d) <= reach[:, None]) & (cells.rows > 0)
            else:
                wanted = first & (cells.rows > 0)
            row, cell = np.nonzero(wanted)
            n = cells.blocks[cell].astype(int)
            row, cell = np.repeat(row, n), np.repeat(cell, n)
            block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            for at in range(0, len(row), HANDED_ON):
                part = slice(at, at + HANDED_ON)
                taken = batch.select(["id", "x"]).take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell[part].astype(np.int32)), pa.array(block[part].astype(np.int32))], ["id", "x", "cell", "block"]
                )

    return b.mapInArrow(run, "id STRING, x ARRAY<DOUBLE>, cell INT, block INT")


def _searched(a: DataFrame, routed: DataFrame, k: int, group_rows: int) -> DataFrame:
    """The k best of each block for the queries routed to it; queries of a crowded block are dealt out."""
    on = ["cell", "block"]
    parts = routed.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(group_rows)).cast("int").alias("_parts"))
    own, other = (parts.select(*[F.col(c).alias(c) for c in on], F.col("_parts").alias(n)) for n in ("_own", "_other"))
    train = a.join(own, on).select(*a.columns, F.explode(F.sequence(F.lit(0), F.col("_own") - 1)).alias("part"))
    test = routed.join(other, on).select(*routed.columns, F.pmod(F.xxhash64("id"), F.col("_other")).cast("int").alias("part"))
    return train.groupBy(*on, "part").cogroup(test.groupBy(*on, "part")).applyInPandas(
        _best_of_block(k), "id STRING, dist DOUBLE, other STRING, label INT"
    )


def nearest_pruned(
    train: DataFrame, test: DataFrame, cols: list[str], k: int = 5, key: str = KEY, group_rows: int = GROUP_ROWS,
    pivots: int | None = None,
) -> tuple[DataFrame, float]:
    """As :func:`nearest`, exact, without looking at cells that can't matter; and the
    share of (query, block) pairs that were skipped.

    Training rows go to the cell of their nearest pivot, one of a bounded sample.
    A query is searched in its nearest cells first; a cell whose rows, by their
    distances from its pivot, are all farther than the k-th row found is skipped.
    """
    x = F.array(*[F.col(c).cast("double") for c in cols]).alias("x")
    a = train.select(F.col(key).alias("id"), F.col("label").cast("int").alias("label"), x)
    b = durable(test.select(F.col(key).alias("id"), x))
    total = a.count()
    n = min(MOST_PIVOTS, max(1, math.ceil(total / group_rows))) if pivots is None else min(pivots, MOST_PIVOTS)
    # with all pivots in use, blocks grow with their cells instead of becoming many
    group_rows = max(group_rows, min(GROUP_ROWS, math.ceil(4 * total / MOST_PIVOTS)))
    chosen = a.orderBy(F.xxhash64("id")).limit(n).select("x").collect()
    if not chosen or b.isEmpty():
        none = f"{key} STRING, neighbours ARRAY<STRUCT<dist: DOUBLE, other: STRING, label: INT>>"
        return train.sparkSession.createDataFrame([], none), 0.0
    points = np.unique(np.array([r.x for r in chosen]), axis=0)
    placed = durable(_cells_of(a, points))
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("from_pivot").alias("lo"), F.max("from_pivot").alias("hi")).collect()
    cells = Cells(points, *(np.zeros(len(points)) for _ in range(4)))
    for r in stats:  # one row per pivot
        cells.low[r.cell], cells.high[r.cell], cells.rows[r.cell] = r.lo, r.hi, r.n
    cells.blocks = np.ceil(cells.rows / group_rows)
    split = F.array(*[F.lit(int(c)) for c in cells.blocks])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(split[F.col("cell")], F.lit(1))).cast("int"))
    first = durable(_routed(b, cells, k, second=False))
    near = durable(_searched(placed, first, k, group_rows))
    reach = _merged(near, k, max(2, int(cells.blocks.sum())), "id").select(
        "id", F.when(F.size("neighbours") >= k, F.element_at("neighbours", -1)["dist"]).otherwise(float("inf")).alias("reach")
    )
    rest = durable(_routed(b.join(reach, "id"), cells, k, second=True))
    best = near.unionByName(_searched(placed, rest, k, group_rows))
    visited, pairs = first.count() + rest.count(), b.count() * int(cells.blocks.sum())
    return _merged(best, k, max(2, int(cells.blocks.sum())), key), 1.0 - visited / max(pairs, 1)


def knn_predict(train: DataFrame, test: DataFrame, cols: list[str], k: int = 5, key: str = KEY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, prediction): most frequent label of the k nearest, smallest on a tie."""
    labels = F.array_sort(F.transform("neighbours", lambda n: n["label"]))
    ranked = F.transform(
        F.array_distinct(labels),
        lambda c: F.struct((-F.size(F.filter(labels, lambda y: y == c))).alias("n"), c.alias("label")),
    )
    return nearest(train, test, cols, k, key, group_rows).select(key, F.array_min(ranked)["label"].alias("prediction"))
