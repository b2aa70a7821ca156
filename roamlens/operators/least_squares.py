"""Least squares per group by merged QR factors (TSQR).

Rows of a group [x | y] are replaced, wherever they lie, by the triangle of their QR
decomposition: a factor as small as the design is wide. Factors are stacked and
decomposed again, eight at a time, until each group has one; its triangle solves
the problem. Unlike sums of products this doesn't square the condition of the
design, and no group is ever held by one task.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roamlens.session import durable

# Rows stacked before they are decomposed, groups a task holds open, factors merged at once.
STACK, OPEN, MERGED = 2048, 64, 8


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def _factors(df: DataFrame, key: str) -> DataFrame:
    """(key, n, width, factor) from every partition, without a shuffle."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()  # key: [rows seen, stacked rows]

        def out(k, n, blocks) -> pa.RecordBatch:
            r = _triangle(np.concatenate(blocks))
            return pa.RecordBatch.from_arrays(
                [pa.array([k], names.type), pa.array([n]), pa.array([r.shape[1]], pa.int32()), pa.array([r.tobytes()], pa.binary())],
                [key, "n", "width", "factor"],
            )

        for batch in batches:
            names = batch.column(0)
            x, y = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            if batch.num_rows == 0:
                continue
            rows = np.column_stack([x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), y])
            found = names.dictionary_encode()
            codes, uniques = found.indices.to_numpy(), found.dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(uniques) + 1))
            for c, k in enumerate(uniques):
                mine = rows[order[bounds[c] : bounds[c + 1]]]
                n, blocks = held.pop(k, (0, []))
                blocks.append(mine)
                if sum(map(len, blocks)) > STACK:
                    blocks = [_triangle(np.concatenate(blocks))]
                held[k] = (n + len(mine), blocks)
                if len(held) > OPEN:  # the group seen longest ago
                    old, (n, blocks) = held.popitem(last=False)
                    yield out(old, n, blocks)
        for k, (n, blocks) in held.items():
            yield out(k, n, blocks)

    schema = f"{key} {kind.simpleString()}, n LONG, width INT, factor BINARY"
    return df.select(key, F.col("x"), F.col("y").cast("double").alias("y")).mapInArrow(run, schema)


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.frombuffer(f).reshape(-1, w) for f, w in zip(pdf["factor"], pdf["width"])])


def least_squares(df: DataFrame, key: str, ridge: float = 0.0, free: int = 0) -> DataFrame:
    """(key, n, coef): minimises |y - x coef|^2 + ridge |coef|^2 per key.

    ``df`` has the key, ``x`` (an array of equal length everywhere) and ``y``; rows
    with a null among them are left out. The first ``free`` coefficients bear no penalty.
    Without a unique solution the shortest one is given.
    """
    kind = df.schema[key].dataType.simpleString()
    factors = durable(_factors(df.where(f"{key} IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), key).withColumn("_i", F.monotonically_increasing_id()))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _triangle(_stack(pdf))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [int(pdf["n"].sum())], "width": [r.shape[1]], "factor": [r.tobytes()], "_i": [int(pdf["_g"].iloc[0])]})

    while True:
        sizes = factors.groupBy(key).agg(F.count("*").alias("_c"))
        if sizes.where("_c > 1").isEmpty():
            break
        # a group's factors are dealt into sets of about eight by their hash
        sets = F.ceil(F.col("_c") / F.lit(MERGED))
        dealt = factors.join(sizes, key).withColumn("_g", F.pmod(F.xxhash64("_i"), F.greatest(sets, F.lit(1))).cast("long"))
        factors = durable(dealt.groupBy(key, "_g").applyInPandas(merge, f"{key} {kind}, n LONG, width INT, factor BINARY, _i LONG"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coefs = []
            for width, factor in zip(batch.column("width").to_pylist(), batch.column("factor").to_pylist()):
                r = np.frombuffer(factor).reshape(-1, width)
                penalty = np.sqrt(ridge) * np.eye(width - 1)[free:]
                x = np.concatenate([r[:, :-1], penalty]) if ridge else r[:, :-1]
                y = np.concatenate([r[:, -1], np.zeros(len(x) - len(r))])
                coefs.append(np.linalg.lstsq(x, y, rcond=None)[0])
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n"), pa.array(coefs, pa.list_(pa.float64()))], [key, "n", "coef"])

    return factors.select(key, "n", "width", "factor").mapInArrow(solve, f"{key} {kind}, n LONG, coef ARRAY<DOUBLE>")
