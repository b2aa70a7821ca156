"""Labeling functions and the vote table.

A labeling function (LF) votes a class index or abstains (-1). Votes are
Columns over metric tables; plain Python functions are the exception.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from roamlens.operators.scope import KEY

ABSTAIN = -1
TRIED = 512  # rows of a failing batch that each order is tried out on


@dataclass(frozen=True)
class LF:
    """``vote`` is a Column over the LF's metric table, giving a class id;
    ``allowed`` are the class ids it may give."""

    name: str
    vote: Column
    allowed: tuple[int, ...]


def lf_predicate(name: str, label: int, predicate: Column, allowed: tuple[int, ...] | None = None) -> LF:
    """Vote ``label`` where the predicate holds; NULL abstains."""
    return LF(name, F.when(predicate, F.lit(label)).otherwise(F.lit(ABSTAIN)), allowed or (label,))


def lf_template(name: str, field: str, op: str, value, label: int) -> LF:
    """One comparison of a field: op is '>', '<' or '=='."""
    c, v = F.col(field), F.lit(value)
    return lf_predicate(name, label, {">": c > v, "<": c < v, "==": c == v}[op])


def lf_regex(name: str, field: str, pattern: str, label: int) -> LF:
    """Vote where the whole text of the field has a match anywhere."""
    return lf_predicate(name, label, F.col(field).cast("string").rlike(pattern))


def lf_python(name: str, fn: Callable[[dict], int], fields: list[str], allowed: tuple[int, ...]) -> LF:
    """A Python function of one row. A label outside ``allowed`` and an
    exception abstain, each for its row only. Runs in Arrow batches."""
    ok = frozenset(allowed)

    def one(row: dict) -> int:
        try:
            label = int(fn(row))
        except Exception:
            return ABSTAIN
        return label if label in ok else ABSTAIN

    @F.pandas_udf("int")
    def votes(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([one(r) for r in rows.to_dict("records")], dtype="int32")

    return LF(name, votes(F.struct(*fields)), allowed)


def lf_batch(name: str, fn: Callable[[pd.DataFrame], object], fields: list[str], allowed: tuple[int, ...]) -> LF:
    """A Python function of whole Arrow batches: a DataFrame of the fields in, one
    label a row out.

    Missing labels and labels outside ``allowed`` abstain, and so do rows that the
    function raises for, or whose labels don't fit them, when they stand alone. Rows
    are handed over in growing runs that shrink where one fails. The order of the
    runs is that of the field under which refused rows lie closest together, which is
    tried out on TRIED rows per order: about one call for each refused row, if a field
    tells them apart, else fewer than two a row.
    The function must give a row the same label whatever rows it comes with.
    """
    ok = np.array(sorted(allowed))
    spent = {by: [0, 0] for by in (None, *fields)}  # calls, rows; by order, in this worker

    def label(rows: pd.DataFrame) -> np.ndarray | None:
        try:
            labels = pd.to_numeric(pd.Series(np.asarray(fn(rows))), errors="raise")
            if len(labels) != len(rows):
                raise ValueError(f"{len(labels)} labels for {len(rows)} rows")
        except Exception:
            return None
        values = labels.to_numpy(dtype=float, na_value=np.nan)
        return np.where(np.isin(values, ok), values, ABSTAIN).astype(np.int32)

    def in_runs(rows: pd.DataFrame, by: str | None) -> np.ndarray:
        out = np.full(len(rows), ABSTAIN, np.int32)
        order = np.arange(len(rows))
        if by is not None:
            try:
                order = np.argsort(rows[by].to_numpy(), kind="stable")
            except Exception:  # values without an order
                pass
        rows = rows.iloc[order]
        at, n = 0, len(rows)
        while at < len(rows):
            n = min(n, len(rows) - at)
            run = rows.iloc[at : at + n]
            run.index = pd.RangeIndex(n)
            spent[by][0] += 1
            labels = label(run)
            if labels is None and n > 1:
                n //= 2
                continue
            if labels is not None:
                out[order[at : at + n]] = labels
            at += n
            n = n if labels is None else 2 * n
        spent[by][1] += len(rows)
        return out

    def cast(rows: pd.DataFrame) -> np.ndarray:
        whole = label(rows) if len(rows) else np.zeros(0, np.int32)
        if whole is not None:
            return whole
        parts, at = [], 0
        for by in spent:
            left = TRIED - spent[by][1]  # a small batch may hold only part of a trial
            if left > 0 and at < len(rows):
                parts.append(in_runs(rows.iloc[at : at + left], by))
                at += left
        if at < len(rows):
            best = min(spent, key=lambda by: spent[by][0] / spent[by][1])
            parts.append(in_runs(rows.iloc[at:], best))
        return np.concatenate(parts)

    @F.pandas_udf("int")
    def votes(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(cast(rows), dtype="int32")

    return LF(name, votes(F.struct(*fields)), allowed)


def class_ids(lfs: list[LF]) -> list[int]:
    """Sorted union of the LFs' class ids; position = class index."""
    return sorted({c for lf in lfs for c in lf.allowed})


def _indexed(lf: LF, classes: list[int]) -> Column:
    index = reduce(
        lambda acc, ic: acc.when(lf.vote == F.lit(ic[1]), F.lit(ic[0])),
        [(i, c) for i, c in enumerate(classes) if c in lf.allowed],
        F.when(F.lit(False), F.lit(ABSTAIN)),
    )
    return index.otherwise(F.lit(ABSTAIN))


def label_matrix(entities: DataFrame, sources: list[tuple[DataFrame, list[LF]]], key: str = KEY) -> DataFrame:
    """(key, votes ARRAY<INT>) of every entity; an uncovered entity abstains.

    LFs over one metric table are evaluated together; the tables meet in one
    aggregate on the key instead of a join per LF. If a table has an entity
    twice, the larger vote of the copies counts.
    """
    lfs = [lf for _, group in sources for lf in group]
    classes, m = class_ids(lfs), len(lfs)
    parts, at = [], 0
    for df, group in sources:
        votes = [_indexed(lf, classes).alias(f"v{at + i}") for i, lf in enumerate(group)]
        filler = [F.lit(ABSTAIN).alias(f"v{j}") for j in range(m) if not at <= j < at + len(group)]
        parts.append(df.select(key, *votes, *filler))
        at += len(group)
    cols = [f"v{j}" for j in range(m)]
    if len(parts) == 1:
        table = parts[0].groupBy(key).agg(*[F.max(c).alias(c) for c in cols])
    else:
        table = reduce(DataFrame.unionByName, parts).groupBy(key).agg(*[F.max(c).alias(c) for c in cols])
    votes = F.array(*[F.coalesce(F.col(c), F.lit(ABSTAIN)) for c in cols])
    return entities.select(key).distinct().join(table, key, "left").select(key, votes.alias("votes"))
