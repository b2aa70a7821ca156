"""Language identification by nearest clustered centroid of TF-IDF n-gram vectors."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from roamlens.llm.common import carried, crc_of

UNKNOWN = "und"
FEATURES = 4096  # hashed letter n-grams, n = 1 to 3
SAMPLE = 2000  # labelled documents that the centroids are fitted on, over all languages
CENTROIDS = 4  # per language
PIECE = 1 << 18  # characters vectorised at once
LENGTHS = 24  # bins of log2(letters) for the rejection
THIN = 20  # rows that a bin needs for a bound of its own
NEAR = 0.6  # of the lowest thousandth of the cosines of a bin


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of hashed 1- to 3-grams of the lower-cased letters, and the number
    of letters. Runs of other characters are one space."""
    counts, letters = np.zeros(FEATURES, np.int64), 0
    known = _letters()
    lower = (text or "").lower()
    tail = np.array([32], np.uint32)
    for at in range(0, len(lower), PIECE):
        codes = np.frombuffer(lower[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = known[codes]
        letters += int(letter.sum())
        codes = np.where(letter, codes, np.uint32(32))
        codes = np.concatenate([tail, codes])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        fresh = len(tail) - 1  # grams within the tail were counted before
        c = codes.astype(np.uint64)
        h = c * np.uint64(0x9E3779B97F4A7C15)
        grams = [h[fresh + 1 :]]
        for _ in range(2):
            h = (h[:-1] + c[len(c) - len(h) + 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            grams.append(h[max(0, fresh + 1 - (len(c) - len(h))) :])
        index = (np.concatenate(grams) >> np.uint64(40)) % np.uint64(FEATURES)
        counts += np.bincount(index.astype(np.int64), minlength=FEATURES)
        tail = codes[-2:]
    return counts, letters


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    owner: np.ndarray  # language of each centroid
    cutoff: np.ndarray  # least cosine by length bin

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float32)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        out = []
        for at in range(0, len(texts), 256):
            counted = [gram_counts(t) for t in texts[at : at + 256]]
            letters = np.array([n for _, n in counted])
            if not self.languages:
                out += [(UNKNOWN, 0.0, True)] * len(counted)
                continue
            cosine = self.vectors(np.stack([c for c, _ in counted])) @ self.centroids.T
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)
            far = score < self.cutoff[length_bin(letters)]
            for b, s, r, n in zip(best.tolist(), score.tolist(), far.tolist(), letters.tolist()):
                out.append((self.languages[self.owner[b]], s, r) if n else (UNKNOWN, 0.0, True))
        return out


def length_bin(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), LENGTHS - 1)


def spherical_clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows, from a farthest-first start; clusters of under
    2 % of the rows (mislabelled or odd texts) are left out unless all are."""
    mean = x.mean(axis=0)
    centres = [x[int((x @ mean).argmax())]]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int((x @ np.stack(centres).T).max(axis=1).argmin())])
    c = np.stack(centres)
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[nearest == j].sum(axis=0) if (nearest == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    size = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    large = size >= max(2, 0.02 * len(x))
    return c[large] if large.any() else c[size.argmax()][None]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for t in batch.column(0):
            df += gram_counts(t.as_py())[0] > 0
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["feature", "df"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [gram_counts(t.as_py()) for t in batch.column(1)]
        packed = [np.minimum(c, 65535).astype("<u2").tobytes() for c, _ in made]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed, pa.binary()), pa.array([n for _, n in made], pa.int64())],
            ["lang", "counts", "letters"],
        )


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel:
    """Learn from (doc_id, text, lang); rows with a null lang, text or doc_id are left out.

    Document frequencies are counted over all rows. The centroids are clustered
    on about ``sample`` rows, in equal parts by language, picked by a hash of
    doc_id. The rejection needs no labels: a text is too far from every centroid
    if its cosine is below ``NEAR`` of what the lowest thousandth of all training
    rows of its length (log2 of letters) has; a length with under ``THIN`` rows
    takes the bound of the next one that has more.
    """
    rows = labelled.select("doc_id", "text", "lang").dropna()
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(sample + 1).collect()}
    if len(counts) > sample:
        raise ValueError(f"{sample} rows can't show more than {sample} languages")
    if not counts:
        return LanguageModel([], np.zeros(FEATURES), np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(LENGTHS))
    each = max(1, sample // len(counts))
    spark = labelled.sparkSession
    rates = spark.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang STRING, rate DOUBLE")
    df = np.zeros(FEATURES, np.int64)
    for r in (
        rows.select("text").mapInArrow(_document_frequencies, "feature BIGINT, df BIGINT")
        .groupBy("feature").agg(F.sum("df").alias("df")).collect()
    ):
        df[r.feature] = r.df
    total = sum(counts.values())
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.05)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = (
        rows.join(F.broadcast(rates), "lang").filter(drawn < F.col("rate")).select("lang", "text")
        .mapInArrow(_counted, "lang STRING, counts BINARY, letters BIGINT").filter("letters > 0").collect()
    )
    chosen.sort(key=lambda r: (r.lang, r.counts))
    languages = sorted({r.lang for r in chosen})
    model = LanguageModel(languages, idf, np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(LENGTHS))
    found, owner = [], []
    if not chosen:
        return model
    x = model.vectors(np.stack([np.frombuffer(r.counts, "<u2") for r in chosen]))
    of = np.array([languages.index(r.lang) for r in chosen])
    for k in range(len(languages)):
        c = spherical_clusters(x[of == k], centroids)
        found.append(c)
        owner += [k] * len(c)
    model.centroids, model.owner = np.concatenate(found).astype(np.float32), np.array(owner)
    model.cutoff = _cutoffs(rows.select("text"), model)
    return model


def _cutoffs(texts: DataFrame, model: LanguageModel) -> np.ndarray:
    """The least cosine a text of each length may have, from one aggregate over all ``texts``."""
    shipped = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                counted = [gram_counts(t) for t in batch.column(0).slice(at, 256).to_pylist()]
                letters = np.array([n for _, n in counted])
                cosine = (own.vectors(np.stack([c for c, _ in counted])) @ own.centroids.T).max(axis=1)
                some = letters > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(length_bin(letters)[some].astype(np.int32)), pa.array(cosine[some].astype(float))], ["bin", "cosine"]
                )

    found = texts.mapInArrow(run, "bin INT, cosine DOUBLE").groupBy("bin").agg(
        F.count("*").alias("n"), F.percentile_approx("cosine", 0.001, 10_000).alias("low")
    ).collect()  # one row a length
    shipped.unpersist()
    known = {r.bin: r.low for r in found if r.n >= THIN} or {r.bin: r.low for r in found}
    if not known:
        return np.zeros(LENGTHS)
    nearest = [min(known, key=lambda k: (abs(k - b), known[k])) for b in range(LENGTHS)]
    return NEAR * np.array([known[k] for k in nearest])


def identify(docs: DataFrame, model: LanguageModel, carry: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, rejected.

    ``lang_pred`` is the language of the nearest centroid and ``score`` its
    cosine, over the whole text. Null, empty and letterless texts give ``und``,
    score 0, rejected; so does every text if nothing was learned. ``rejected``
    also marks texts too far from all centroids. ``carry`` adds the struct
    ``carried`` with all columns of ``docs``; else they are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["doc_id", "text"]
    source = docs.select(F.col("doc_id"), F.col("text"), *[carried(docs)] * carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shipped.value.predict(batch.column(1).to_pylist())
            made = [
                pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
            ]
            rest = [batch.column(k) for k in range(len(columns), batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *made, *rest], ["doc_id", "lang_pred", "score", "rejected", "carried"][: 4 + len(rest)]
            )

    fields = [
        source.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType()),
        StructField("rejected", BooleanType()), *[f for f in source.schema if f.name == "carried"],
    ]
    return source.mapInArrow(run, StructType(fields))


def split(docs: DataFrame) -> tuple:
    """(training rows of ``docs``, column held_out): crc32 of doc_id as text, modulo 3, is 1 for held-out rows."""
    held_out = crc_of(F.col("doc_id")) % 3 == 1
    return docs.filter(~held_out), held_out
