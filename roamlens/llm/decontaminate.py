"""Benchmark decontamination by winnowed word fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from roamlens.llm.common import carried, staged, text_bytes

SPAN = 10  # words of a window
GRAM = 5  # words of a fingerprinted k-gram
# Benchmark words that are searched for at once. Larger benchmarks are split
# into blocks of this many words, and all documents meet every block.
BLOCK_WORDS = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
# odd multipliers modulo 2^64: the polynomial's base with its inverse, the k-gram's base, the final mix
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM_BASE, _MIX = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_STEP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _STEP), _powers(_BASE_INVERSE, _STEP)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: a-z after lower-casing A-Z, digits
    and everything beyond ASCII belong to words, all else separates them."""
    octets = _LOWER[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(_IN_WORD[octets], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    # sums of octet * base^i per word, with i counted anew every _STEP octets, then shifted to the word's start
    out = np.empty(len(starts), np.uint64)
    lead = 0
    while lead < len(starts):
        at = starts[lead]
        stop = max(lead + 1, int(np.searchsorted(ends, at + _STEP, "right")))
        if ends[stop - 1] - at > _STEP:  # one word of over _STEP octets
            digest = hashlib.blake2b(octets[at : ends[lead]].tobytes(), digest_size=8).digest()
            out[lead] = int.from_bytes(digest, "little")
        else:
            part = octets[at : ends[stop - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)], dtype=np.uint64)])
            a, b = starts[lead:stop] - at, ends[lead:stop] - at
            out[lead:stop] = (sums[b] - sums[a]) * _DOWN[a]
        lead = stop
    return _mixed(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _GRAM_BASE + words[j : j + n]
    return _mixed(h)


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every ``window`` consecutive ones (all
    positions of it, if it repeats): each span of ``window`` hashes has one."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = grams[:n].copy()
    for j in range(1, window):
        np.minimum(low, grams[j : j + n], out=low)
    chosen = np.zeros(len(grams), bool)
    for j in range(window):
        chosen[j : j + n] |= grams[j : j + n] == low
    return np.flatnonzero(chosen)


@dataclass
class Index:
    """Fingerprints of one block of benchmark items, sorted by hash."""

    ids: list[str]
    words: np.ndarray  # hashes of the words of all items
    first: np.ndarray  # first word of each item
    last: np.ndarray  # one past its last word
    grams: np.ndarray  # sorted fingerprints
    places: np.ndarray  # their words, in the order of grams
    owner: np.ndarray  # their items
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> sorted hashes of whole short items, their items

    def find(self, sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (index into wanted, index into sorted_hashes) of equal hashes."""
        lo, hi = np.searchsorted(sorted_hashes, wanted, "left"), np.searchsorted(sorted_hashes, wanted, "right")
        some = np.flatnonzero(hi > lo)
        counts = (hi - lo)[some]
        offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(some, counts), np.repeat(lo[some], counts) + offsets


def build_index(items: list[tuple[str, bytes]], span: int, k: int) -> Index:
    hashed = [(i, word_hashes(t)) for i, t in items]
    hashed = [(i, w) for i, w in hashed if len(w)]
    lengths = np.array([len(w) for _, w in hashed], np.int64)
    last = np.cumsum(lengths)
    first = last - lengths
    grams, places, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    short: dict[int, list] = {}
    for n, (_, w) in enumerate(hashed):
        if len(w) < span:
            short.setdefault(len(w), []).append((gram_hashes(w, len(w))[0], n))
            continue
        g = gram_hashes(w, k)
        at = winnowed(g, span - k + 1)
        grams.append(g[at])
        places.append(first[n] + at)
        owner.append(np.full(len(at), n))
    g, p, o = np.concatenate(grams), np.concatenate(places), np.concatenate(owner)
    order = np.argsort(g, kind="stable")
    whole = {}
    for m, pairs in short.items():
        pairs.sort()
        whole[m] = (np.array([h for h, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64))
    words = np.concatenate([w for _, w in hashed]) if hashed else np.empty(0, np.uint64)
    return Index([i for i, _ in hashed], words, first, last, g[order], p[order], o[order], whole)


def hits(text: bytes, index: Index, span: int, k: int) -> tuple[int, list[int], list[int], list[str]]:
    """Words of a text, first and one-past-last words of the hit runs, ids of the items that hit."""
    words = word_hashes(text)
    n = len(words)
    starts, ends, found = [], [], set()
    if n >= span and len(index.grams):
        grams = gram_hashes(words, k)
        at = winnowed(grams, span - k + 1)
        which, fps = index.find(index.grams, grams[at])
        i, j, item = at[which], index.places[fps], index.owner[fps]
        if len(i):
            # one run per (item, diagonal) and stretch: grow to both sides while words agree
            left, right = np.zeros(len(i), np.int64), np.full(len(i), k, np.int64)
            for grown, sign in ((left, -1), (right, 1)):
                open_ = np.arange(len(i))
                for _ in range(span - k):
                    if sign < 0:
                        a, b = i[open_] - grown[open_] - 1, j[open_] - grown[open_] - 1
                        ok = (a >= 0) & (b >= index.first[item[open_]])
                    else:
                        a, b = i[open_] + grown[open_], j[open_] + grown[open_]
                        ok = (a < n) & (b < index.last[item[open_]])
                    ok[ok] = words[a[ok]] == index.words[b[ok]]
                    open_ = open_[ok]
                    grown[open_] += 1
                    if not len(open_):
                        break
            # the k-gram itself is compared too: equal hashes needn't be equal words
            same = np.ones(len(i), bool)
            for d in range(k):
                same &= words[i + d] == index.words[j + d]
            full = same & (left + right >= span)
            starts.append((i - left)[full])
            ends.append((i + right)[full])
            found.update(item[full].tolist())
    for m, (hashes, items) in index.short.items():
        if n >= m:
            grams = gram_hashes(words, m)
            known = np.flatnonzero(np.isin(grams, hashes))
            which, fps = index.find(hashes, grams[known])
            i, item = known[which], items[fps]
            same = np.ones(len(i), bool)
            for d in range(m):
                same &= words[i + d] == index.words[index.first[item] + d]
            starts.append(i[same])
            ends.append(i[same] + m)
            found.update(item[same].tolist())
    if not found:
        return n, [], [], []
    a, b = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return n, a[new].tolist(), b[np.append(new[1:] - 1, len(b) - 1)].tolist(), [index.ids[x] for x in found]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most ``block_words`` words (a longer item is a block)."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_bytes().alias("text")
    )
    block, room = [], block_words
    for r in items.toLocalIterator():
        size = len(r.text) // 2 + 1  # no text has more words than that
        if block and size > room:
            yield block
            block, room = [], block_words
        block.append((r.item_id, bytes(r.text)))
        room -= size
    yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM, block_words: int = BLOCK_WORDS,
    carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, spans
    (array of {start, stop}, word positions of the maximal hit runs), item_ids.

    A word is hit inside any occurrence of ``span`` consecutive words of an item,
    or of a whole item with fewer words (but some). Winnowing keeps the smallest
    k-gram hash of every span-k+1 neighbours on both sides, so a shared span
    always shares a kept fingerprint on the same diagonal; matching fingerprints
    are extended word by word and only full spans count. Shorter items, for
    which that guarantee doesn't hold, are looked up whole.

    Null and empty texts have no words; items without words match nothing; a
    null item_id counts as an empty one; items with one id are one item in
    item_ids. Rows with equal doc_id keep rows of their own. An empty benchmark
    leaves all documents clean. The benchmark is read in blocks of bounded size,
    each broadcast as an index and met by all documents. ``carry`` adds the
    struct ``carried`` with all columns of ``docs``; else they are ignored.
    """
    runs = ArrayType(LongType())
    current = docs.select("doc_id", text_bytes().alias("text"), *[carried(docs)] * carry)
    found = [
        StructField("n_words", LongType()), StructField("first", runs), StructField("stop", runs),
        StructField("item_ids", ArrayType(StringType())),
    ]
    schema = StructType([*current.schema, *found])
    narrow = StructType([f for f in schema if f.name != "text"])
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_words)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shipped = sc.broadcast(build_index(block, span, k))
        current = current.mapInArrow(_searcher(shipped, span, k, following is not None), narrow if following is None else schema)
        if following is not None:
            current = staged(current)
        block = following
    return current.select(
        "doc_id", "n_words",
        F.arrays_zip(F.col("first").alias("start"), "stop").alias("spans"),
        F.array_sort("item_ids").alias("item_ids"),
        *["carried"] * carry,
    )


def _union(a1: list[int], b1: list[int], a2: list[int], b2: list[int]) -> tuple[list[int], list[int]]:
    out: list[list[int]] = []
    for a, b in sorted([*zip(a1, b1), *zip(a2, b2)]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [x[0] for x in out], [x[1] for x in out]


def _searcher(shipped, span: int, k: int, more: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            found = [hits(t.as_py(), index, span, k) for t in at["text"]]
            if "first" in at:  # what earlier blocks found
                old = [at[name].to_pylist() for name in ("first", "stop", "item_ids")]
                found = [(n, *_union(a, b, oa, ob), [*i, *oi]) for (n, a, b, i), oa, ob, oi in zip(found, *old)]
            at |= {
                "n_words": pa.array([f[0] for f in found], pa.int64()),
                "first": pa.array([f[1] for f in found], pa.list_(pa.int64())),
                "stop": pa.array([f[2] for f in found], pa.list_(pa.int64())),
                "item_ids": pa.array([sorted(set(f[3])) for f in found], pa.list_(pa.string())),
            }
            if not more:
                del at["text"]
            yield pa.RecordBatch.from_arrays(list(at.values()), list(at))

    return run
