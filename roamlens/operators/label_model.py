"""Generative label model, fitted by EM on vote patterns.

P(vote of LF j | class) is a table over {abstain, class 0..k-1}; LFs are
independent given the class and classes are equally likely beforehand. Each
iteration is one Spark job of one stage over the pattern table; a task adds up its
patterns in arrays and returns the expected counts, m * k * (k + 1) numbers, so the
cost of fitting does not depend on the number of entities and only model parameters
visit the driver. ``fit_converged`` speeds the iteration up by squared extrapolation
(SQUAREM) until a step of EM moves nothing any more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

INITIAL_ACCURACY = 0.7


@dataclass(frozen=True)
class LabelModel:
    """``log_p[j][c][v + 1]`` = log P(LF j votes v | class c)."""

    log_p: list[list[list[float]]]
    k: int
    iterations: int

    @property
    def m(self) -> int:
        return len(self.log_p)

    def weights(self) -> list[float]:
        """Chance that a vote of the LF is right, classes equally likely."""
        out = []
        for table in self.log_p:
            right = sum(math.exp(table[c][c + 1]) for c in range(self.k))
            cast = sum(1.0 - math.exp(table[c][0]) for c in range(self.k))
            out.append(right / cast if cast > 0 else 0.0)
        return out


def _initial(m: int, k: int) -> list[list[list[float]]]:
    rest = math.log((1.0 - INITIAL_ACCURACY) / k)
    hit = math.log(INITIAL_ACCURACY)
    return [[[hit if v == c else rest for v in range(-1, k)] for c in range(k)] for _ in range(m)]


def posterior(votes: str, log_p: list[list[list[float]]], k: int) -> Column:
    """P(class | votes) as ARRAY<DOUBLE>; a row expression, no join.

    The parameters go in as one array literal, so the plan stays small and the
    same in every iteration.
    """
    m, width = len(log_p), k + 1
    flat = "array(" + ", ".join(f"{x!r}D" for t in log_p for row in t for x in row) + ")"
    scores = (
        f"transform(sequence(0, {k - 1}), c -> aggregate(sequence(0, {m - 1}), 0D, (acc, j) -> acc + "
        f"element_at({flat}, (j * {k} + c) * {width} + element_at({votes}, j + 1) + 2)))"
    )
    # one-element arrays bind the scores and their exponentials once each
    shares = "transform(array(transform(s, x -> exp(x - array_max(s)))), e -> transform(e, x -> x / aggregate(e, 0D, (t, y) -> t + y)))[0]"
    return F.expr(f"transform(array({scores}), s -> {shares})[0]")


Tables = list[list[list[float]]]
# Patterns that one task handles in an iteration.
TASK_PATTERNS = 50_000


def _expected(votes: np.ndarray, n: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, float]:
    """E step over a batch of patterns: (expected counts by LF, class and vote, log likelihood)."""
    m, k, width = tables.shape
    scores = np.zeros((len(votes), k))
    for j in range(m):
        scores += tables[j][:, votes[:, j] + 1].T
    top = scores.max(axis=1, keepdims=True)
    p = np.exp(scores - top)
    total = p.sum(axis=1, keepdims=True)
    weight = p / total * n[:, None]
    counts = np.empty((m, k, width))
    for j in range(m):
        for c in range(k):
            counts[j, c] = np.bincount(votes[:, j] + 1, weight[:, c], width)
    return counts, float(((top + np.log(total))[:, 0] * n).sum())


def _em_steps(pats: DataFrame, models: list[Tables], k: int) -> list[tuple[Tables, float]]:
    """One E and M step from each of ``models``, in one job: (new tables, objective of the old ones).

    The M step adds one to every (LF, class, vote) count; the objective is the log
    likelihood plus the log of the prior that this stands for, which EM never lowers.
    """
    tables = np.array(models)
    m = tables.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, evidence = np.zeros(tables.shape), np.zeros(len(tables))
        for batch in batches:
            votes = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, m)
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for i, one in enumerate(tables):
                more, likelihood = _expected(votes, n, one)
                counts[i] += more
                evidence[i] += likelihood
        yield pa.RecordBatch.from_arrays([pa.array([counts.ravel().tolist()]), pa.array([evidence.tolist()])], ["counts", "evidence"])

    parts = pats.select("votes", "n").mapInArrow(run, "counts ARRAY<DOUBLE>, evidence ARRAY<DOUBLE>").collect()  # a row per task
    counts = 1.0 + sum((np.array(r.counts).reshape(tables.shape) for r in parts), np.zeros(tables.shape))
    objective = tables.sum(axis=(1, 2, 3)) + sum((np.array(r.evidence) for r in parts), np.zeros(len(tables)))
    return [(t.tolist(), float(o)) for t, o in zip(np.log(counts / counts.sum(axis=3, keepdims=True)), objective)]


def _em_step(pats: DataFrame, log_p: Tables, k: int) -> tuple[Tables, float]:
    return _em_steps(pats, [log_p], k)[0]


def _moved(a: Tables, b: Tables) -> float:
    return max(abs(x - y) for s, t in zip(a, b) for q, r in zip(s, t) for x, y in zip(q, r))


def _stored(pats: DataFrame) -> DataFrame:
    stored = pats.select("votes", "n").persist()
    return stored.coalesce(max(1, -(-stored.count() // TASK_PATTERNS)))


def fit_label_model(pats: DataFrame, m: int, k: int, epochs: int = 100, tolerance: float = 0.0) -> LabelModel:
    """Plain EM for ``epochs`` iterations (``tolerance`` > 0 may stop earlier)."""
    stored, log_p, done = _stored(pats), _initial(m, k), 0
    try:
        for done in range(1, epochs + 1):
            new, _ = _em_step(stored, log_p, k)
            moved, log_p = _moved(new, log_p), new
            if moved < tolerance:
                break
    finally:
        stored.unpersist()
    return LabelModel(log_p, k, done)


def _extrapolated(a: Tables, b: Tables, c: Tables) -> Tables:
    """From three points of the iteration to where their differences shrink to nothing."""
    flat = lambda t: [x for table in t for row in table for x in row]
    r = [y - x for x, y in zip(flat(a), flat(b))]
    v = [z - y - d for y, z, d in zip(flat(b), flat(c), r)]
    length = math.sqrt(sum(x * x for x in r)) / max(math.sqrt(sum(x * x for x in v)), 1e-300)
    alpha = max(length, 1.0)  # at least two plain steps
    far = iter([x + 2 * alpha * d + alpha * alpha * w for x, d, w in zip(flat(a), r, v)])
    out = []
    for table in a:
        rows = []
        for row in table:
            new = [max(next(far), -60.0) for _ in row]
            top = max(new)
            total = top + math.log(sum(math.exp(x - top) for x in new))
            rows.append([x - total for x in new])
        out.append(rows)
    return out


def fit_converged(
    pats: DataFrame, m: int, k: int, rounds: int = 100, tolerance: float = 1e-9, start: LabelModel | None = None
) -> LabelModel:
    """EM to its fixed point, at most ``rounds`` rounds of three EM steps.

    A round takes two steps, extrapolates from them and takes a third from there;
    if that lowers the objective, the round ends with the plain steps. ``start`` is
    an earlier model, e.g. from before new patterns came in. ``iterations`` counts
    EM steps; the last two of a round share a job.
    """
    if start is not None and (start.m != m or start.k != k):
        raise ValueError("the earlier model has other LFs or classes")
    stored, steps = _stored(pats), 0
    log_p = _initial(m, k) if start is None else start.log_p
    try:
        for _ in range(rounds):
            one, _ = _em_step(stored, log_p, k)
            two, _ = _em_step(stored, one, k)
            steps += 2
            if _moved(one, two) < tolerance:
                return LabelModel(two, k, steps)
            far = _extrapolated(log_p, one, two)
            (three, reached), (plain, kept) = _em_steps(stored, [far, two], k)
            steps += 2
            log_p = three if reached >= kept else plain
    finally:
        stored.unpersist()
    return LabelModel(log_p, k, steps)


def predict_proba(votes: DataFrame, model: LabelModel) -> DataFrame:
    """(key, probs)."""
    return votes.withColumn("probs", posterior("votes", model.log_p, model.k)).drop("votes")


def argmax(probs: Column | str) -> Column:
    """Position of the largest element, the first on a tie."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    return F.array_position(probs, F.array_max(probs)).cast("int") - 1


def predict(votes: DataFrame, model: LabelModel) -> DataFrame:
    """(key, label): argmax class; -1 where no LF voted."""
    silent = ~F.exists("votes", lambda v: v != -1)
    label = F.when(silent, F.lit(-1)).otherwise(argmax(posterior("votes", model.log_p, model.k)))
    return votes.withColumn("label", label).drop("votes")


def model_distribution(probs: DataFrame, class_names: list[str]) -> DataFrame:
    """Entities per argmax class of the probabilities, zero rows kept."""
    counted = probs.select(argmax("probs").alias("c")).agg(
        *[F.count_if(F.col("c") == i).alias(f"c{i}") for i in range(len(class_names))]
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("class_name"), F.col(f"c{i}").alias("entities")) for i, n in enumerate(class_names)]
    )
    return counted.select(F.inline(rows))
