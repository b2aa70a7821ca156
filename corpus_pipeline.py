"""Corpus pipeline over ``documents``: each stage reads what the one before kept.

All stages but the last return the columns of ``documents``. A document is named
by its doc_id: rows with one doc_id (null is one too) stay or go together in the
near-duplicate stage, every row is decided by itself in the others. Empty tables
pass through; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roamlens.llm import decontaminate as D, exact as E, langid as L, sentencepieces as SP, simhash as S
from roamlens.llm.common import carried, staged, table

_KEY = ["op_key", "op_sha", "op_points"]


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters (null and empty ones too) and those too far from every language."""
    training, _ = L.split(docs)
    found = L.identify(docs, L.fit(training), carry=True)
    return found.filter(~F.col("rejected")).select("carried.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row that exact dedup keeps of each group.

    It is found again by doc_id, digest and length; of several rows alike in all
    three one stays.
    """
    kept = E.exact_dedup(docs).filter("kept").select(
        _key(F.col("doc_id")).alias("op_key"), F.col("text_sha256").alias("op_sha"), F.col("n_points").alias("op_points")
    ).distinct()
    text = F.coalesce("text", F.lit(""))
    named = docs.select(
        carried(docs), _key(F.col("doc_id")).alias("op_key"),
        F.sha2(F.regexp_replace(text, E.WHITE, ""), 256).alias("op_sha"), F.char_length(text).cast("long").alias("op_points"),
    )
    return named.join(kept, _KEY, "left_semi").dropDuplicates(_KEY).select("carried.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document that names its SimHash component."""
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = S.near_duplicates(docs).filter(own).select(_key(F.col("doc_id")).alias("op_key")).distinct()
    named = docs.select(carried(docs), _key(F.col("doc_id")).alias("op_key"))
    return named.join(kept, "op_key", "left_semi").select("carried.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a span of a benchmark item."""
    found = D.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.filter(F.size("spans") == 0).select("carried.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip): the texts as piece ids, checked by decoding them."""
    vocabulary = SP.Vocabulary()
    source = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    back = SP.encode(source, vocabulary, carry=True, round_trip=True)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids",
        (F.sha2("decoded", 256) == F.col("carried.text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece", pieces),
]
# Language ID, SimHash and the pieces have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
