"""Exact dedup with a heavy-hitter split, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roamlens.llm.common import staged, text_of

WHITE = r"[\x20\x09-\x0D]+"
# Size of the frequent-items summary and of what it may report. Both are fixed,
# so the broadcast winners never exceed HEAVY rows, whatever the input.
TRACKED, HEAVY = 8192, 1024


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_points, digest): SHA-256 of the text without white space.

    ``row`` tells rows with the same doc_id apart; it is fixed by staging.
    """
    text = text_of()
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        F.char_length(text).cast("long").alias("n_points"),
        F.unhex(F.sha2(F.regexp_replace(text, WHITE, ""), 256)).alias("digest"),
    )


def heavy_digests(base: DataFrame) -> DataFrame:
    """At most HEAVY digests that each hold a share of 1/HEAVY of the rows or more.

    ``approx_top_k`` keeps a Misra-Gries summary (counters with a common
    decrement, mergeable, TRACKED of them) per task and merges the summaries;
    a digest with that share can't fall out of it. What it reports is then
    counted exactly, and only digests that reach the share stay.
    """
    # the sketch sees a 64-bit name of the digest; the count below uses the digest
    named = base.withColumn("name", F.xxhash64("digest"))
    top = named.agg(F.expr(f"approx_top_k(name, {HEAVY}, {TRACKED})").alias("top"))
    found = top.select(F.explode("top.item").alias("name"))
    rows = base.count()
    counted = named.join(F.broadcast(found), "name", "left_semi").groupBy("digest").agg(*_best())
    return counted.filter((F.col("group_size") >= 2) & (F.col("group_size") * HEAVY >= rows)).limit(HEAVY)


def _best():
    order = F.struct(
        (-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"
    )
    return F.count("*").alias("group_size"), F.min(order).alias("best")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which row of its group stays.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when they are identical without white space; null counts as
    empty, so empty, blank and null texts are one group. The longest original
    stays, then the smallest doc_id (null after all others), and of rows alike
    in both exactly one. Other columns are ignored; an empty table gives none.

    Digests with a large share of all rows are settled on the map side against
    the broadcast winners and never shuffled; the others meet by digest, with
    counts and winners combined before the shuffle.
    """
    base = staged(digests(docs))
    heavy = staged(heavy_digests(base))
    light = base.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    settled = base.join(F.broadcast(heavy), "digest").unionByName(
        light.join(light.groupBy("digest").agg(*_best()), "digest")
    )
    return settled.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_points",
    )


EXACT_SQL = r"""
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256, n_points
FROM (SELECT doc_id, length(coalesce(text, '')) AS n_points,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
      FROM {documents})
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST)
"""
