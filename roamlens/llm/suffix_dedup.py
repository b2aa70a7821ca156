"""Removal of repeated byte strings with suffix arrays built by Lyndon grouping."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from roamlens.llm.common import staged, text_bytes
from roamlens.llm.decontaminate import _DOWN, _UP, _mixed

LENGTH = 100  # bytes of a string that must not repeat
GRAM = 32  # bytes of an anchor; every string of LENGTH bytes has exactly one
WINDOWS = LENGTH - GRAM + 1  # strings that an anchor can serve
FLANK = (LENGTH - GRAM) // 2  # a string reaches that far from its anchor to one side at least
CHUNK = 1 << 15  # string starts looked at at once
BUCKET = 400_000  # bytes of text that are handed to Python together
SORTED = 10_000  # bytes of text whose suffixes are sorted together, or all pieces of one key
CROWD = 2_000  # pieces with one key that are sorted; the windows of larger groups meet by their bytes

_SPOT = np.uint64((1 << 17) - 1)


def suffix_array(s: Sequence[int]) -> list[int]:
    """Suffixes of ``s`` in order; its last symbol must be the only smallest one.

    Phase 1 groups suffixes by their longest Lyndon prefix. Groups start as
    equal first symbols and are taken from the greatest down. Each member points
    to the nearest suffix before it in a smaller group; a suffix with m such
    pointers from a group has its prefix extended by m times the group's, so it
    moves to a new group right above its own, those with most pointers first.
    Phase 2 goes up through the order as it fills: the suffix before a placed
    one, and whatever its pointers lead to, takes its group's next free place.
    No suffix is renamed or sorted again.
    """
    n = len(s)
    symbols = np.asarray(s)
    by_symbol = np.argsort(symbols, kind="stable")
    ordered = symbols[by_symbol]
    fresh = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    starts = np.repeat(fresh, np.diff(np.append(fresh, n)))
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    of = starts[place].tolist()  # group of a suffix, named by its first place
    sa, at = by_symbol.tolist(), place.tolist()
    size = [0] * n
    for a, b in zip(fresh.tolist(), np.append(fresh[1:], n).tolist()):
        size[a] = b - a
    before = [-1] * n
    top = n - 1
    while top > 0:  # the last suffix, group 0, points nowhere; as of[-1] it ends every walk
        x = sa[top]
        group = of[x]
        if group == top:  # most groups have one member
            p = x - 1
            while of[p] >= group:
                p = before[p]
            before[x] = p
            if p >= 0:
                old = of[p]
                last = old + size[old] - 1
                if last > old:
                    y, i = sa[last], at[p]
                    sa[i], at[y] = y, i
                    sa[last], at[p] = p, last
                    size[old] -= 1
                    size[last] = 1
                    of[p] = last
            top -= 1
            continue
        pointed = []
        for x in sorted(sa[group : top + 1]):
            p = x - 1
            while of[p] >= group:
                p = before[p]
            before[x] = p
            if p >= 0:
                pointed.append(p)
        if len(set(pointed)) == len(pointed):
            levels = (pointed,)
        else:
            by_times: dict[int, list[int]] = {}
            for p, k in Counter(pointed).items():
                by_times.setdefault(k, []).append(p)
            levels = [by_times[k] for k in sorted(by_times, reverse=True)]
        for level in levels:
            moved = {}
            for p in level:
                old = of[p]
                # swap to the end of its group's part that stays
                k = moved.get(old, 0) + 1
                moved[old] = k
                last = old + size[old] - k
                y, i = sa[last], at[p]
                sa[i], at[y] = y, i
                sa[last], at[p] = p, last
            for old, k in moved.items():
                if k < size[old]:
                    first = old + size[old] - k
                    size[old] -= k
                    size[first] = k
                    for i in range(first, first + k):
                        of[sa[i]] = first
        top = group - 1
    free = list(range(n))
    done = bytearray(n)
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        x = out[i] - 1
        while not done[x]:  # done[-1] is the last suffix
            group = of[x]
            out[free[group]] = x
            free[group] += 1
            done[x] = 1
            x = before[x]
    return out


def runs(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (anchor hash, content hash, start, strings, anchor - start) of the
    runs of string starts that share an anchor, chunk by chunk.

    A string's anchor is the GRAM-byte string in it with the least hash, the
    first of equals, so equal strings have equal anchors at equal places.
    """
    octets = np.frombuffer(text, np.uint8)
    for lead in range(0, len(octets) - LENGTH + 1, CHUNK):
        part = octets[lead : lead + CHUNK + LENGTH - 1].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)], dtype=np.uint64)])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(part) - GRAM + 1])
        low = (grams & ~_SPOT) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOWS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < WINDOWS:
            low = np.minimum(low[: -(WINDOWS - width)], low[WINDOWS - width :])
        anchor = (low & _SPOT).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        stop = np.append(begin[1:], len(anchor))
        content = _mixed((sums[stop + LENGTH - 1] - sums[begin]) * _DOWN[begin])
        yield grams[anchor[begin]], content, begin + lead, stop - begin, anchor[begin] - begin


def _packed(start: np.ndarray, strings: np.ndarray, back: np.ndarray) -> np.ndarray:
    return start << 16 | strings << 8 | back


_PLACE = "ord BIGINT, tie INT"
_RUN = f"anchor BIGINT, content BIGINT, {_PLACE}, at BIGINT"


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, of = [], []
        for row, t in enumerate(batch.column(2)):
            for a, c, start, strings, back in runs(t.as_py()):
                found.append((a, c, _packed(start, strings, back)))
                of.append(np.full(len(a), row))
        if found:
            a, c, at = (np.concatenate(x) for x in zip(*found))
            rows = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view("<i8")), pa.array(c.view("<i8")), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at)],
                ["anchor", "content", "ord", "tie", "at"],
            )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the runs in ``runs``, split in two by the side on which a string
    reaches beyond its anchor; pieces that can share a string have one key."""
    names = ["key", "ord", "tie", "start", "piece"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for row, (t, found) in enumerate(zip(at["text"], at["runs"])):
            text = t.as_py()
            for r in found.as_py():
                start, strings, back = r >> 16, r >> 8 & 255, r & 255
                a, stop = start + back, start + strings
                split = min(max(a - FLANK + 1, start), stop)  # strings before it hold FLANK bytes before the anchor
                for p, q, side, flank in (
                    (start, split, b"L", text[a - FLANK : a + GRAM] if split > start else b""),
                    (split, stop, b"R", text[a : a + GRAM + FLANK]),
                ):
                    if q > p:
                        key = int.from_bytes(hashlib.blake2b(side + flank, digest_size=8).digest(), "little", signed=True)
                        values = (key, at["ord"][row].as_py(), at["tie"][row].as_py(), p, text[p : q + LENGTH - 1])
                        for c, v in zip(cols, values):
                            c.append(v)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names)


def repeated(place: np.ndarray, pieces: list[bytes], starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings of LENGTH bytes in ``pieces``, all but the first occurrence
    of each: (piece, start). ``place`` orders the pieces' documents. Equal pieces
    are sorted once; what the order says of their strings holds for all of them."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(p, len(number)) for p in pieces], np.int64)
    # one text: the different pieces, each closed by a symbol below all bytes, and the least symbol at the end
    flat = [np.frombuffer(p, np.uint8).astype(np.int64) + 2 for p in number]
    lengths = np.array([len(p) + 1 for p in number])
    whole = np.concatenate([x for p in flat for x in (p, [1])] + [np.zeros(1, np.int64)])
    begin = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(number)), lengths)
    offset = np.arange(len(of)) - begin[of]
    fits = np.append(offset + LENGTH < lengths[of], False)
    order = np.array(suffix_array(whole), np.int64)
    order = order[fits[order]]  # strings that are equal are neighbours in the order
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    octets = whole.astype(np.int16)
    same = np.empty(len(order), bool)
    same[0] = False
    ahead = np.arange(LENGTH)
    for at in range(1, len(order), 20_000):
        a, b = order[at : at + 20_000], order[at - 1 : at - 1 + 20_000]
        same[at : at + 20_000] = (octets[a[:, None] + ahead] == octets[b[: len(a), None] + ahead]).all(axis=1)
    copies = np.bincount(which, minlength=len(number))
    n = copies[of[order]]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order, group = np.repeat(order, n), np.repeat(np.cumsum(~same), n)
    piece = np.argsort(which, kind="stable")[(np.cumsum(copies) - copies)[of[order]] + nth]
    start = np.array(starts, np.int64)[piece] + offset[order]
    rank = np.lexsort((start, place[piece], group))
    later = np.concatenate([[False], group[rank][1:] == group[rank][:-1]])
    return piece[rank][later], start[rank][later]


def can_repeat(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece the first string of LENGTH bytes whose hash another string
    of ``pieces`` has too, and the end of its last one (0, 0: there is none)."""
    lengths = np.array([len(p) for p in pieces])
    begin = np.cumsum(lengths) - lengths
    octets = np.frombuffer(b"".join(pieces), np.uint8)
    strings = np.maximum(lengths - LENGTH + 1, 0)
    of = np.repeat(np.arange(len(pieces)), strings)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = begin[of] + offset
    hashes = np.empty(len(of), np.uint64)
    for lead in range(0, len(octets), CHUNK):  # the table of powers is of bounded size
        a, b = np.searchsorted(at, [lead, lead + CHUNK])
        part = octets[lead : lead + CHUNK + LENGTH - 1].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)], dtype=np.uint64)])
        here = at[a:b] - lead
        hashes[a:b] = (sums[here + LENGTH] - sums[here]) * _DOWN[here]
    _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    first, stop = np.full(len(pieces), 1 << 62), np.zeros(len(pieces), np.int64)
    np.minimum.at(first, of[again], offset[again])
    np.maximum.at(stop, of[again], offset[again] + LENGTH)
    return np.where(stop > 0, first, 0), stop


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """Later occurrences of strings in the pieces of a bucket. Strings whose hash
    no other string has are cut off; what is left is sorted by runs of whole keys."""
    table = table.sort_by("key")
    key, ords, ties, starts, pieces = (table.column(n).to_pylist() for n in ("key", "ord", "tie", "start", "piece"))
    times = Counter(key)
    kept = [i for i in range(len(key)) if times[key[i]] > 1]
    out = [[np.zeros(0, np.int64)] for _ in range(2)]  # document, start
    docs = sorted({(ords[i], ties[i]) for i in kept})
    if kept:
        first, stop = (x.tolist() for x in can_repeat([pieces[i] for i in kept]))
        number = {d: k for k, d in enumerate(docs)}
        together: list[tuple[int, int, bytes]] = []  # (document, start, text)
        size = 0
        for k, (i, a, b) in enumerate(zip(kept, first, stop)):
            if b:
                together.append((number[ords[i], ties[i]], starts[i] + a, pieces[i][a:b]))
                size += b - a
            last = k + 1 == len(kept)
            if together and (last or size >= SORTED and key[kept[k + 1]] != key[i]):
                place = np.array([d for d, *_ in together])
                which, start = repeated(place, [t for *_, t in together], [s for _, s, _ in together])
                out[0].append(place[which])
                out[1].append(start)
                together, size = [], 0
    doc, start = map(np.concatenate, out)
    ord_, tie = (np.array([d[k] for d in docs], np.int64)[doc] for k in (0, 1))
    return pa.table([pa.array(ord_), pa.array(tie, pa.int32()), pa.array(start), pa.array(start + LENGTH)], names=["ord", "tie", "start", "stop"])


def _sorted_runs(table: pa.Table) -> pa.Table:
    """The later occurrences in a bucket, joined to runs: a long repeat is one span, not one for each string."""
    found = _sorted_bucket(table)
    ord_, tie, start, stop = (c.to_numpy() for c in found.columns)
    docs, row = np.unique(np.stack([ord_, tie], axis=1), axis=0, return_inverse=True)
    row, start, stop = joined_spans(row.reshape(-1), start, stop)
    return pa.table([pa.array(docs[row, 0]), pa.array(docs[row, 1], pa.int32()), pa.array(start), pa.array(stop)], names=found.column_names)


def _later_strings(pieces: DataFrame) -> DataFrame:
    """Repeated strings of crowded keys, string by string: equal bytes meet."""
    windows = pieces.select(
        "ord", "tie", "start", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - LENGTH)).alias("i")
    ).select("ord", "tie", (F.col("start") + F.col("i")).alias("start"), F.substring("piece", F.col("i") + 1, F.lit(LENGTH)).alias("bytes"))
    first = windows.groupBy("bytes").agg(F.min(F.struct("ord", "tie", "start")).alias("first"))
    return windows.join(first, "bytes").filter(F.struct("ord", "tie", "start") != F.col("first")).select(
        "ord", "tie", "start", (F.col("start") + LENGTH).alias("stop")
    )


def joined_spans(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, stop) of the maximal runs that spans of rows cover, in order;
    spans that overlap or touch are one run."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    lead = row * (int(stop.max(initial=0)) + 1)  # so that the ends of a row are beyond those of the rows before
    reach = np.maximum.accumulate(stop + lead)
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | ((start + lead)[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    return row[first], start[first], (reach - lead)[last]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        size = pc.binary_length(at["text"]).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = at["copy"].to_numpy(zero_copy_only=False).astype(bool) & (size >= LENGTH)
        found = pc.list_parent_indices(at["spans"]).to_numpy(zero_copy_only=False).astype(np.int64)
        spans = at["spans"].flatten()
        start, stop = (spans.field(n).to_numpy(zero_copy_only=False) for n in ("start", "stop"))
        others = ~whole[found]
        copies = np.flatnonzero(whole)
        row, start, stop = joined_spans(
            np.concatenate([found[others], copies]),
            np.concatenate([start[others], np.zeros(len(copies), np.int64)]),
            np.concatenate([stop[others], size[copies]]),
        )
        runs_of = np.bincount(row, minlength=batch.num_rows)
        gone = np.zeros(batch.num_rows, np.int64)
        np.add.at(gone, row, stop - start)
        ends = np.cumsum(runs_of).tolist()
        start, stop = start.tolist(), stop.tolist()
        kept = []
        for t, a, b in zip(at["text"], [0, *ends], ends):
            text = t.as_py()
            if b > a:
                text = b"".join(text[p:q] for p, q in zip([0, *stop[a:b]], [*start[a:b], len(text)]))
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [at["doc_id"], *(pa.array(x, pa.int64()) for x in (size, gone, runs_of)), pa.array(kept, pa.binary())], names
        )


def _first_of_groups(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans of runs that repeat an earlier run whole, first runs of anchors with different runs)."""
    whole = F.struct("ord", "tie", "at")
    firsts = staged(found.groupBy("anchor", "content").agg(F.min(whole).alias("first")))
    spans = found.join(firsts, ["anchor", "content"]).filter(whole != F.col("first")).select(
        "ord", "tie", F.shiftright("at", 16).alias("start"),
        (F.shiftright("at", 16) + F.shiftright("at", 8).bitwiseAND(F.lit(255)) + LENGTH - 1).alias("stop"),
    )
    several = firsts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    return spans, firsts.join(several, "anchor", "left_semi").select("first.ord", "first.tie", "first.at")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (integer doc_id, text): doc_id, n_bytes,
    n_removed, n_spans, kept (binary): the UTF-8 text without every byte covered
    by a string of LENGTH bytes that also starts earlier.

    Earlier is a smaller doc_id (null comes last), or an earlier start in the
    document; of rows with one doc_id the smaller text hash, and of rows alike
    one row, is first. Null counts as empty. Texts under LENGTH bytes stay whole.
    Other columns are ignored; an empty table gives none.

    Equal strings share an anchor. Runs of strings around one anchor that are
    equal as a whole are settled by aggregates on (anchor, content), however
    many copies there are. Only one copy of each different run of an anchor goes
    on: what of its text can repeat is sorted, in runs of whole keys, by
    ``suffix_array``, and of equal strings, now neighbours, all but the first are
    removed. Keys with very many different runs are settled by joins on the
    strings instead.
    """
    numbered = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), text_bytes().alias("text")
    ).withColumn("tie", F.xxhash64("text").cast("string").substr(-9, 9).cast("int"))
    found = numbered.select("ord", "tie", "text").mapInArrow(_find_runs, _RUN)
    shared = staged(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    found = staged(found.join(shared, "anchor", "left_semi"))
    spans, open_runs = _first_of_groups(found)
    spans, open_runs = staged(spans), staged(open_runs)

    by_doc = open_runs.groupBy("ord", "tie").agg(F.collect_list("at").alias("runs"))
    pieces = numbered.select("ord", "tie", "text").join(by_doc, ["ord", "tie"]).mapInArrow(
        _pieces, f"key BIGINT, {_PLACE}, start BIGINT, piece BINARY"
    ).dropDuplicates(["key", "ord", "tie", "start"])
    pieces = staged(pieces)
    keys = pieces.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = keys.filter(F.col("n") > CROWD).select("key")
    pairs = pieces.join(keys.filter(F.col("n") <= CROWD).select("key"), "key", "left_semi")
    total = pieces.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))
    sorted_ = pairs.groupBy(F.pmod(F.col("key"), F.lit(buckets)).alias("bucket")).applyInArrow(
        _sorted_runs, f"{_PLACE}, start BIGINT, stop BIGINT"
    )
    strings = _later_strings(pieces.join(crowded, "key", "left_semi"))
    spans = spans.unionByName(sorted_).unionByName(strings)

    # a text that an earlier row has as a whole is removed as a whole
    slim = staged(numbered.select("ord", "tie", F.length("text").cast("long").alias("stop"), F.sha2("text", 256).alias("sha")))
    doc = F.struct("ord", "tie")
    first = slim.groupBy("sha").agg(F.min(doc).alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = slim.filter(F.col("stop") >= LENGTH).join(first, "sha").filter(doc != F.col("first"))
    spans = spans.unionByName(copies.select("ord", "tie", F.lit(0).cast("long").alias("start"), "stop"))

    removed = spans.groupBy("ord", "tie").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    alike = Window.partitionBy("ord", "tie").orderBy("ord")
    joined = numbered.join(removed, ["ord", "tie"], "left").withColumn("copy", F.row_number().over(alike) > 1)
    counts = [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    return joined.select("doc_id", "text", "spans", "copy").mapInArrow(
        _cut, StructType([docs.schema["doc_id"], *counts, StructField("kept", BinaryType())])
    )
