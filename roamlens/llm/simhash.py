"""SimHash near-dedup by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from roamlens.llm.common import staged, text_bytes
from roamlens.llm.components import connected_components

BITS, SEED = 64, 42
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of one text, as an unsigned 64-bit number.

    Lower-cases A-Z only; words end at ASCII white space. Repeated shingles
    count each time. Fewer words than ``width`` make one shingle, none give 0.
    """
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    if len(words) > width:
        starts = (ends - lengths)[: 1 - width].tolist()
        ends = ends[width - 1 :].tolist()
    else:
        starts, ends = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], "<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = [np.bincount(octets[:, k], minlength=256) @ _BIT_OF_BYTE for k in range(8)]
    majority = 2 * np.concatenate(counts) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))], ["doc_id", "fp"])

    schema = StructType([StructField("doc_id", kind), StructField("fp", LongType())])
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, schema)


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 bit masks; two words at ``radius`` or fewer differing bits
    agree under at least one of them.

    Bit i carries a non-zero vector m(i) of radius+1 bits, and mask v keeps the
    bits with odd <m(i), v>. The vectors of ``radius`` differing bits don't span
    the space, so some v is orthogonal to all of them, and its mask drops them.
    """
    vectors = 2 ** (radius + 1) - 1
    carried = [1 + i % vectors for i in range(BITS)]
    return [
        sum(1 << i for i, m in enumerate(carried) if bin(m & v).count("1") % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of
    all pairs at ``radius`` (2) or fewer differing bits.

    Every fingerprint enters one bucket per covering mask. Within buckets that
    hold several, members are not paired: each one is sent to itself and to its
    neighbours at one bit that the mask drops. Two members differ in at most two
    bits exactly if such a place is common to both, and a place has 65
    fingerprints around it at most, so its group is bounded and linked as a star.
    """
    if radius != 2:
        raise ValueError("linking through one-bit neighbours is exact for a radius of 2")
    masks = covering_masks(radius)
    tables = F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)
    ])
    placed = prints.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    crowded = placed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key")
    flips = F.array(*[
        F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks
    ])
    hubs = placed.join(crowded, ["t", "key"], "left_semi").select(
        "fp", F.explode(flips[F.col("t")]).alias("flip")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    around = hubs.groupBy("hub").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return around.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex
    digits), component_id (smallest doc_id reachable over links).

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with equal fingerprints are folded to one before the search, so copies,
    however many, cost one row. A null doc_id gets a row too, but names a
    component only if all its rows are null. Other columns are ignored.
    """
    prints = staged(fingerprints(docs, width))
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = connected_components(links(distinct.select("fp"), radius), "u", "v")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    component = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(component, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
