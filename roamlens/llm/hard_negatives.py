"""Hard-negative mining: exact scores by a residue-number-system GEMM, then windowed selection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from roamlens.llm.common import staged

# A residue is at most 125 in size, so 1024 products sum to less than 2^24 and
# float32 holds every partial sum exactly.
LARGEST, INNER = 251, 1024
# Rows and anchors of one matrix product, and the bytes of one block of anchors.
ROWS, ANCHORS, BLOCK_BYTES = 1024, 256, 16 << 20
FOUND = "slot INT, score LONG, id LONG"


def moduli(bound: int) -> list[int]:
    """Primes from 251 downwards whose product exceeds twice ``bound``."""
    primes, product = [], 1
    for p in range(LARGEST, 2, -1):
        if product > 2 * bound:
            break
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            primes.append(p)
            product *= p
    return primes


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p in -(p-1)/2 … (p-1)/2. The first step may miss by one p, the second mends it."""
    inverse = x.dtype.type(1 / p)
    x = x - p * np.rint(x * inverse)
    return x - p * np.rint(x * inverse)


def residues(whole: np.ndarray, primes: list[int]) -> np.ndarray:
    """(prime, row, dimension) float32 residues of whole numbers held as float64; fmod is exact."""
    return np.stack([_balanced(np.fmod(whole, p), p).astype(np.float32) for p in primes])


def products(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact inner products (rows of a) x (rows of b) as int64, from their residues.

    One float32 matrix product per prime; the mixed-radix digits of Chinese
    remaindering are balanced, so they give the signed number without a shift.
    """
    digits: list[np.ndarray] = []
    total, weight = 0, 1
    for k, p in enumerate(primes):
        r = np.zeros((a.shape[1], b.shape[1]), np.float32)
        for at in range(0, a.shape[2], INNER):
            r = _balanced(r + _balanced(a[k, :, at : at + INNER] @ b[k, :, at : at + INNER].T, p), p)
        for q, digit in zip(primes, digits):
            r = _balanced((r - digit) * np.float32(pow(q, -1, p)), p)
        digits.append(r)
        with np.errstate(over="ignore"):
            total = total + r.astype(np.int64) * np.int64(weight)
        weight *= p
    return total


@dataclass
class Windows:
    """Searches over a block of anchors: window w takes rows of (or not of) its
    anchor's label with low[w] <= score <= high[w] and keeps the first ``k``."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


def _first(w: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each w by score descending, id ascending; equal (score, id) count once."""
    order = np.lexsort((ids, ~score, w))
    w, score, ids = w[order], score[order], ids[order]
    if len(w):
        new = np.r_[True, (w[1:] != w[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])]
        w, score, ids = w[new], score[new], ids[new]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        w, score, ids = w[rank < k], score[rank < k], ids[rank < k]
    return w, score, ids


def _matrix(vectors: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) by row; shorter vectors end in zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return out


def _search(rows: DataFrame, block: tuple, windows: Windows, primes: list[int], dims: int, scale: float) -> DataFrame:
    """(slot = window, score, id): the first k of every window within each partition."""
    shared = rows.sparkSession.sparkContext.broadcast((block, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, whole), win = shared.value
        left = residues(whole, primes)
        best = tuple(np.array([], np.int64) for _ in range(3))
        floor = win.low.copy()  # rises to the k-th best score found
        order = np.argsort(win.anchor, kind="stable")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row_ids, row_labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                right = residues(_matrix(part.column(2), dims, scale), primes)
                found = [best]
                for first in range(0, len(ids), ANCHORS):
                    span = slice(*np.searchsorted(win.anchor[order], [first, first + ANCHORS]))
                    score = products(left[:, first : first + ANCHORS], right, primes)
                    fits = labels[first : first + ANCHORS, None] == row_labels
                    if not win.same:
                        fits = ~fits
                    fits &= ids[first : first + ANCHORS, None] != row_ids
                    for w in np.array_split(order[span], max(1, len(order[span]) // ANCHORS)):
                        own = win.anchor[w] - first
                        s = score[own]
                        hit, row = np.nonzero((s >= floor[w, None]) & (s <= win.high[w, None]) & fits[own])
                        found.append((w[hit], s[hit, row], row_ids[row]))
                best = _first(*(np.concatenate(x) for x in zip(*found)), win.k)
                full, start, n = np.unique(best[0], return_index=True, return_counts=True)
                last = (start + n - 1)[n == win.k]
                floor[full[n == win.k]] = best[1][last]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[0].astype(np.int32)), pa.array(best[1]), pa.array(best[2])], ["slot", "score", "id"]
        )

    return rows.mapInArrow(run, FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k of each slot over all partitions, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(
    items: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0
) -> DataFrame:
    """Hard negatives of every anchor and positive: (anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score).

    ``items`` has vec_id, label and vector (an array of numbers). Rows with a null
    in any of the three, or with a null or non-finite component, take no part.
    Each component x counts as floor(scale * x); a score is the exact integer inner
    product, shorter vectors counting as ended in zeros. Higher scores come first,
    ties by smaller vec_id. ``is_anchor`` picks the anchors. An anchor's positives
    are its first ``positives`` rows of the same label, its negatives for one of
    them the first ``negatives`` rows of another label whose score lies between
    ``low`` and ``high`` percent of the positive's. A vec_id names a row: an anchor
    never meets its own vec_id, repeated rows count once, and rows that share a
    vec_id and differ are rows of their own. Empty tables give empty results; other
    columns are ignored. Scores that may pass 2^62 are an error.

    Anchors are met block by block (``BLOCK_BYTES``, broadcast), each block with
    all rows: once for the positives, once for the windows these define.
    """
    spark = items.sparkSession
    usable = items.filter(
        "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"
    ).filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    usable = usable.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("vector", lambda x: x.cast("double")).alias("vector"), is_anchor.alias("anchor"),
    )
    square = F.aggregate("vector", F.lit(0.0), lambda n, x: n + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    picked = usable.filter("anchor").select("vec_id", "label", "vector").distinct()
    longest, dims = usable.agg(F.max(square), F.max(F.size("vector"))).first()
    n_anchors = picked.count()
    dims = max(dims or 0, 1)
    # every score is at most the largest squared norm
    bound = int((longest or 0.0) * 1.001) + 1
    if bound >= 1 << 62:
        raise ValueError("scores may not fit a 64-bit integer")
    primes = moduli(bound)
    blocks = max(1, math.ceil(n_anchors * (dims + 2) * 8 / BLOCK_BYTES))
    picked = staged(picked.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks))))
    rows = usable.select("vec_id", "label", "vector")
    out = None
    for b in range(blocks):
        table = picked.filter(F.col("block") == b).orderBy("vec_id", "label", "vector").toArrow().combine_chunks()
        if table.num_rows == 0:
            continue
        vectors = table.column("vector").combine_chunks()
        block = (table.column("vec_id").to_numpy(), table.column("label").to_numpy(), _matrix(vectors, dims, scale))
        n = len(block[0])
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        best = Windows(np.arange(n), np.full(n, least), np.full(n, most), True, positives)
        near = _merged(_search(rows, block, best, primes, dims, scale), positives).orderBy("slot", "rank").toArrow()
        own, score, named = (near.column(c).to_numpy().astype(np.int64) for c in ("slot", "score", "id"))
        floors = np.array([-(-low * s // 100) for s in score.tolist()], np.int64)
        roofs = np.array([high * s // 100 for s in score.tolist()], np.int64)
        found = _merged(_search(rows, block, Windows(own, floors, roofs, False, negatives), primes, dims, scale), negatives)
        windows = spark.createDataFrame(
            pa.table({"slot": pa.array(np.arange(len(own), dtype=np.int32)), "anchor_id": block[0][own], "positive_id": named, "positive_score": score})
        )
        mined = found.join(F.broadcast(windows), "slot").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        mined = staged(mined) if blocks > 1 else mined
        out = mined if out is None else out.unionByName(mined)
    if out is None:
        return spark.createDataFrame(
            [], "anchor_id LONG, positive_id LONG, rank INT, negative_id LONG, positive_score LONG, negative_score LONG"
        )
    return out


MINING_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM {embeddings}
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
