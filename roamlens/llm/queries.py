"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roamlens.llm import (
    attention_lm as A, decontaminate as D, exact as E, hard_negatives as H, jaccard_join as J, langid as L, preferences as P, prefix_trie as R, sentencepieces as SP, simhash as S, suffix_dedup as U,
    surrogates as X, toxicity as T,
)
from roamlens.llm.common import table

# Keyed surrogates need a secret; this one is for the given tables only.
SECRET = b"roamlens sample tables"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.exact_dedup(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = U.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training, held_out = L.split(docs)
    found = L.identify(docs, L.fit(training))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = A.score_texts(docs, docs.filter(~A.held_out()))
    return scored.select(
        "doc_id", A.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text and what comes back from them, as digests."""
    vocabulary = SP.Vocabulary()
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    back = SP.encode(docs, vocabulary, carry=True, round_trip=True)
    decoded = F.sha2("decoded", 256)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        decoded.alias("decoded_sha256"), (decoded == F.col("carried.text_sha256")).alias("round_trip"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = T.fit(docs.filter(~T.held_out()), labels)
    return T.score_toxicity(docs, model).select(
        "doc_id", T.held_out().alias("held_out"), "score", (F.col("score") >= T.CUTOFF).cast("int").alias("predicted")
    )


def op7_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.format_preferences(P.preference_pairs(table(spark, sf_dir, "conversations")))
    return rows.withColumns({c: P.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = X.pseudonymize(table(spark, sf_dir, "documents"), SECRET)
    return clean.select(
        "doc_id", F.size("spans").cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",").alias("kinds"),
        (F.size("spans") > 0).alias("changed"), "text",
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conversation_trie(table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    items = vectors.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return H.mine_hard_negatives(items, F.col("vec_id") % 100 == 0)


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_exact_dedup, op3_language_id, op4_lm_scoring, op5_sentencepiece, op6_toxicity,
        op7_preference_formatting, op8_suffix_array_dedup, op9_benchmark_decontamination, op10_pii_surrogates,
        op11_conversation_trie, op12_hard_negatives, op13_ngram_jaccard_join,
    )
}
SQL = {
    "op2_exact_dedup": E.EXACT_SQL.format(documents="documents"),
    "op7_preference_formatting": P.PREFERENCES_SQL.format(conversations="conversations"),
    "op11_conversation_trie": R.TRIE_SQL.format(conversations="conversations"),
    "op12_hard_negatives": H.MINING_SQL.format(embeddings="embeddings"),
    "op13_ngram_jaccard_join": J.JACCARD_SQL.format(documents="documents"),
}
