"""Toxicity scores from a counterfactually regularised logistic classifier."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from roamlens.llm.common import crc_of

# Groups of terms that may stand for each other in a counterfactual text.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("femmes", "hommes"), ("chrétien", "musulman", "juif"),
    ("frauen", "männer"), ("christlich", "muslimisch", "jüdisch"),
    ("mujeres", "hombres"), ("cristiano", "musulmán", "judío"),
)
SAMPLE = 12_000  # labelled texts that the classifier is fitted on
VOCABULARY = 80_000  # features with a weight: the most frequent of the sample
LEAST = 3  # texts of the sample that a feature needs
TELLING = 4.5  # standard errors by which a feature's share must differ between the labels
CUTOFF = 0.3

# lower-cased text as bytes: ASCII other than letters, digits and ' separates words
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def features(words: set[bytes]) -> set[bytes]:
    """The words and, marked with -, their first 4 and 5 bytes, which word families share."""
    return words | {w[:4] + b"-" for w in words} | {w[:5] + b"-" for w in words}


def swapped(words: set[bytes], groups: tuple = IDENTITY_TERMS) -> list[set[bytes]]:
    """The counterfactual word sets of a text: each identity term replaced by
    every other term of its group in turn, and by none, one term at a time."""
    out = []
    for group in groups:
        terms = [t.encode() for t in group]
        for t in terms:
            if t in words:
                out += [(words - {t}) | {other} for other in terms if other != t] + [words - {t}]
    return out


@dataclass
class ToxicityModel:
    bias: float = -20.0  # nothing learned: no text is toxic
    weights: dict[bytes, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        get = self.weights.get
        z = np.array([sum(filter(None, map(get, features(words_of(t))))) for t in texts], float) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _sparse(rows: Iterable[set[bytes]], column: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    r, c = array("i"), array("i")
    for i, found in enumerate(rows):
        known = [column[w] for w in found if w in column]
        r.extend([i] * len(known))
        c.extend(known)
    return np.array(r, np.int64), np.array(c, np.int64)


def _telling(df: Counter, positive: Counter, n: int, n1: int) -> set[bytes]:
    """Features in LEAST texts or more whose share differs between the labels by
    over TELLING standard errors; the others would only be learned by heart."""
    out = set()
    for w, k in df.items():
        if k >= LEAST:
            p, p1 = k / n, positive[w] / n1
            p0 = (k - positive[w]) / (n - n1)
            if abs(p1 - p0) > TELLING * (max(p * (1 - p), 0.5 / n) * (1 / n1 + 1 / (n - n1))) ** 0.5:
                out.add(w)
    return out


def train(
    texts: list[bytes], labels: list[int], groups: tuple = IDENTITY_TERMS, penalty: float = 1.0,
    ridge: float = 2e-3, steps: int = 300,
) -> ToxicityModel:
    """Logistic regression on the presence of features in ``texts`` (their
    distinct words, joined by spaces) plus ``penalty`` times the mean
    squared change of the log-odds between a text and its counterfactuals.

    Gradient steps with momentum from zero weights, shortened where the loss would
    rise, so the result only depends on the rows. With one class only the score is that class for every text.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(20.0 if len(y) and y[0] else -20.0)
    sets = lambda: (set(t.split()) for t in texts)  # noqa: E731  one text's at a time
    pairs = [(features(t), features(s)) for t in sets() for s in swapped(t, groups)]
    df, positive = Counter(), Counter()
    for t, label in zip(sets(), labels):
        found = features(t)
        df.update(found)
        if label:
            positive.update(found)
    tells = _telling(df, positive, len(texts), int(y.sum()))
    tells |= {w for t, s in pairs for w in t ^ s}
    kept = sorted(tells, key=lambda w: (-df[w], w))[:VOCABULARY]
    column = {w: k for k, w in enumerate(kept)}
    n, m, width = len(texts), len(pairs), len(kept)
    r, c = _sparse(map(features, sets()), column)
    # a counterfactual's change of log-odds is linear in the weights: +1 for features that came, -1 for those that went
    came = _sparse((s - t for t, s in pairs), column)
    went = _sparse((t - s for t, s in pairs), column)
    dr, dc = np.concatenate([came[0], went[0]]), np.concatenate([came[1], went[1]])
    dv = np.concatenate([np.ones(len(came[0])), -np.ones(len(went[0]))])
    seen = np.bincount(c, minlength=width) / n
    scale = 1.0 / np.sqrt(seen * (1 - seen) + 0.01)  # rare features learn as fast as frequent ones
    w, b = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb = np.zeros(width), 0.0
    pace = 4.0 / np.sqrt(max(1.0, len(r) / n))
    best, kept = np.inf, (w, b)
    for _ in range(steps):
        z = np.clip(np.bincount(r, w[c], minlength=n) + b, -40, 40)
        change = np.bincount(dr, dv * w[dc], minlength=m) if m else np.zeros(1)
        decay = 5 * ridge / n
        loss = np.mean(np.logaddexp(0, z) - y * z) + decay * (w @ w) + penalty * np.mean(change**2)
        if loss > best:  # too far: back to the best weights, with shorter steps from rest
            (w, b), vw, vb, pace = kept, np.zeros(width), 0.0, pace / 2
            continue
        best, kept = loss, (w, b)
        error = 1.0 / (1.0 + np.exp(-z)) - y
        grad = np.bincount(c, error[r], minlength=width) / n + 2 * decay * w
        if m:
            grad += 2 * penalty / m * np.bincount(dc, dv * change[dr], minlength=width)
        vw = 0.9 * vw - pace * scale * grad
        vb = 0.9 * vb - pace * error.mean()
        w, b = w + vw, b + vb
    w, b = kept
    return ToxicityModel(float(b), {k: float(w[j]) for k, j in column.items()})


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [b" ".join(sorted(words_of(t.as_py()))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> ToxicityModel:
    """Learn from texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers.

    At most about ``sample`` labelled ids are drawn by a hash of doc_id and
    broadcast; the texts never shuffle. Null ids and labels are left out; of
    several labels of one id the greatest counts.
    """
    known = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return ToxicityModel()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n))
    chosen = known.filter(drawn).limit(2 * sample)  # the hash alone keeps to about half of that
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
        .mapInArrow(_word_sets, "toxic INT, words BINARY").collect()
    )
    rows.sort(key=lambda r: (r.words, r.toxic))
    return train([bytes(r.words) for r in rows], [int(r.toxic > 0) for r in rows], **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text), over whole texts.

    Null and empty texts have the score of a text without words. Other columns
    are ignored, rows with equal doc_id are scored one by one.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shipped.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    schema = StructType([docs.schema["doc_id"], StructField("score", DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out():
    return crc_of(F.col("doc_id")) % 4 == 2
