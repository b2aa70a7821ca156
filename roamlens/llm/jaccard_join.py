"""N-gram Jaccard join: documents grouped by equal prefix and size, groups paired, members verified."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from roamlens.llm.common import staged, text_bytes
from roamlens.llm.components import connected_components

SEED = 42
# Bytes of a text split at once; words remembered by a worker and their length.
SLICE, REMEMBERED, SHORT = 1 << 22, 1 << 18, 64
# Shingles gathered before they are dealt out, and shingles of one part of the hash space.
FLUSH, PART, LEAST_PARTS = 1 << 21, 1 << 22, 32
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29), np.uint64(32))


class _Words(dict):
    """Hash of every word; short ones are remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


_words = _Words()


def _word_hashes(text: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(text):
        stop = at + SLICE
        cut = _SPACE.search(text, stop) if stop < len(text) else None
        stop = cut.start() if cut else len(text)
        words = text[at:stop].lower().split()  # bytes: only A-Z change, only ASCII white space splits
        parts.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
        at = stop
    return np.concatenate(parts) if parts else np.array([], np.uint64)


def shingles(text: bytes, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; of all its words
    together if they are fewer than ``width``."""
    words = _word_hashes(text)
    n = min(width, len(words))
    if n == 0:
        return words
    a, b, r, s = _MIX
    mixed = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ words[k : len(words) - n + 1 + k]) * a
        mixed ^= mixed >> r
        mixed *= b
        mixed ^= mixed >> s
    return np.unique(mixed)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest): size and 128-bit digest of every row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(1)]
            sizes, digests = pa.array(map(len, found), pa.int32()), pa.array(map(_digest, found), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, digests], ["doc_id", "n", "digest"])

    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n", IntegerType()), StructField("digest", BinaryType())
    ])
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, schema)


def prefix_size(n: Column, percent: int) -> Column:
    """Of two sets at the threshold, the first n - ceil(n * t) + 1 members in any
    common order share one."""
    return n - F.ceil(n * percent / F.lit(100)) + 1


def _dealt(found: list[np.ndarray], parts: int) -> Iterator[tuple]:
    """Rows (part, flush, owners, counts, keys, common, inside, inside_counts) of some distinct sets.

    For a part of the hash space: 64-bit names of the sets that have shingles which
    no other set here has, how many each, the 32-bit keys of these; the keys that
    several sets here have, once each; the sets that have such, and how many each.
    """
    names = np.frombuffer(b"".join(_digest(f)[:8] for f in found), ">i8").astype(np.int64)
    names, first = np.unique(names, return_index=True)
    found = [found[i] for i in first]
    flush = xxhash.xxh64_intdigest(names.tobytes(), SEED) - (1 << 63)
    owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
    tokens = np.concatenate(found)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]]
    single = new & np.r_[new[1:], True]
    part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    keys = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    bounds = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        at = slice(bounds[p], bounds[p + 1])
        own, alone = owner[at], single[at]
        if len(own) == 0:
            continue
        who, n = np.unique(own[alone], return_counts=True)
        inside, m = np.unique(own[~alone], return_counts=True)
        by_owner = np.argsort(own[alone], kind="stable")
        yield (
            p, flush, names[who].tobytes(), n.astype(np.uint32).tobytes(), keys[at][alone][by_owner].tobytes(),
            keys[at][new[at] & ~alone].tobytes(), names[inside].tobytes(), m.astype(np.uint32).tobytes(),
        )


_DEALT = "part INT, flush LONG, owners BINARY, counts BINARY, keys BINARY, common BINARY, inside BINARY, inside_counts BINARY"
_FIELDS = [f.split()[0] for f in _DEALT.split(", ")]


def _gathered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Shingle sets of the texts in the last column, up to about FLUSH shingles at a time."""
    held, size = [], 0
    for batch in batches:
        for t in batch.column(batch.num_columns - 1):
            held.append(shingles(t.as_py(), width))
            size += len(held[-1])
            if size >= FLUSH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _deal(docs: DataFrame, width: int, parts: int) -> DataFrame:
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, width):
            if found := [f for f in held if len(f)]:
                columns = zip(*_dealt(found, parts))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _FIELDS)

    return docs.select(text_bytes().alias("text")).mapInArrow(run, _DEALT)


def _shared_in_part(table: pa.Table) -> pa.Table:
    """(flush, name, n): how many of a set's shingles in this part other sets have too."""
    rows = table.to_pylist()
    read = lambda kind, c: [np.frombuffer(r[c], kind) for r in rows]
    flushes = np.array([r["flush"] for r in rows])
    owners, inside = read(np.int64, "owners"), read(np.int64, "inside")
    name, n = np.concatenate(owners), np.concatenate(read(np.uint32, "counts"))
    keys = np.concatenate(read(np.uint32, "keys"))
    common = np.unique(np.concatenate(read(np.uint32, "common")))
    entry = np.repeat(np.arange(len(name)), n)
    order = np.argsort(keys, kind="stable")
    keys, entry = keys[order], entry[order]
    hits = np.zeros(len(name), np.int64)
    if len(keys):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        named = name[entry]
        several = np.minimum.reduceat(named, starts) != np.maximum.reduceat(named, starts)
        several |= np.isin(keys[starts], common)
        hits += np.bincount(entry[np.repeat(several, np.diff(np.r_[starts, len(keys)]))], minlength=len(name))
    flush = np.r_[np.repeat(flushes, [len(o) for o in owners]), np.repeat(flushes, [len(o) for o in inside])]
    name = np.r_[name, np.concatenate(inside)]
    hits = np.r_[hits, np.concatenate(read(np.uint32, "inside_counts")).astype(np.int64)]
    some = hits > 0
    return pa.table({"flush": flush[some], "name": name[some], "n": hits[some]})


def shared_counts(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """(name, n_shared): of every distinct set, how many shingles occur in another one.

    Shingles are dealt by ranges of their hash; within a range 32 bits of it tell
    them apart, so n_shared may be a little too high and is never too low. Copies
    of a set have one name and count once. A shingle that many sets have is sent
    once by each batch of texts.
    """
    apart = _deal(docs, width, parts).groupBy("part").applyInArrow(_shared_in_part, "flush LONG, name LONG, n LONG")
    # every batch that holds a copy of a set counts all of its shared shingles
    counted = apart.groupBy("flush", "name").agg(F.sum("n").alias("n"))
    return counted.groupBy("name").agg(F.max("n").alias("n_shared"))


def _members(docs: DataFrame, width: int) -> DataFrame:
    """(digest, tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, width):
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, held), pa.binary()), tokens], ["digest", "tokens"])

    return docs.select("text").mapInArrow(run, "digest BINARY, tokens ARRAY<LONG>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of sets whose intersection is at least ``percent`` of their union."""
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    same = both.withColumn("same", F.size(F.array_intersect("u_tokens", "v_tokens")))
    union = F.size("u_tokens") + F.size("v_tokens") - F.col("same")
    return same.filter(100 * F.col("same") >= percent * union).select("u", "v")


def grouped(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(groups, members): sets of one size and one prefix are one group.

    Shingles are ordered by the number of sets that have them, then by hash. Those
    that one set alone has come first and can't match: a group keeps the rest of
    its prefix. groups: gid, n, alone (how many of the prefix match nothing),
    prefix, members (count); members: sid, gid. Sets without a shared shingle in
    their prefix have no partner and are left out.
    """
    tokens = sets.select("sid", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = tokens.join(counts, "token").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    kept = ranked.withColumn("alone", alone).withColumn("left", (prefix_size(F.col("n"), percent) - alone).cast("int")).filter("left > 0")
    prefixed = kept.select("sid", "n", "alone", F.slice("shared", F.lit(1), F.col("left"))["token"].alias("prefix"))
    named = staged(prefixed.withColumn(
        "gid", F.sha2(F.concat_ws(",", F.col("n").cast("string"), F.transform("prefix", lambda t: t.cast("string"))), 256)
    ))
    groups = named.groupBy("gid").agg(
        F.first("n").alias("n"), F.first("alone").alias("alone"), F.first("prefix").alias("prefix"),
        F.count("*").alias("members"), F.min("sid").alias("first_sid"),
    )
    return staged(groups), named.select("sid", "gid")


def _to_leaders(groups: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of every set with the first set of the leading group of its fullest posting.

    A posting is a shingle and a class of sizes that may match each other; its
    leader has the fewest shingles of its own. The pairs join large families of
    near copies; what they leave out the pairs of ``_across`` find.
    """
    step = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent)))
    postings = groups.select("gid", "alone", "members", "first_sid", step.alias("step"), F.explode("prefix").alias("token"))
    leaders = postings.groupBy("token", "step").agg(
        F.sum("members").alias("total"), F.min(F.struct("alone", "first_sid")).alias("leader")
    )
    chosen = postings.join(leaders, ["token", "step"]).groupBy("gid").agg(F.max(F.struct("total", "token", "leader")).alias("best"))
    led = members.join(chosen.select("gid", F.col("best.leader.first_sid").alias("v")), "gid")
    return led.select(F.col("sid").alias("u"), "v").filter("u <> v")


def _across(groups: DataFrame, members: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets from different components that the prefix and size filters leave.

    The members of a group in one component are a unit. In a posting, units outside
    the component with most units meet all others; pairs of units must fit by size
    and by what their places in the order leave for the overlap. Units are expanded
    to their members at the end.
    """
    placed = members.join(roots, F.col("sid") == F.col("node"), "left").select(
        "sid", "gid", F.coalesce("root", "sid").alias("root")
    )
    placed = staged(placed)
    units = placed.groupBy("gid", "root").agg(F.count("*").alias("sets"))
    postings = units.join(groups.select("gid", "n", "alone", F.posexplode("prefix").alias("place", "token")), "gid").select(
        "token", "gid", "root", "n", (F.col("alone") + F.col("place")).alias("place")
    )
    sizes = postings.groupBy("token", "root").agg(F.count("*").alias("units"))
    most = sizes.groupBy("token").agg(F.max(F.struct("units", "root"))["root"].alias("main"), F.count("*").alias("roots"))
    mixed = staged(postings.join(most.filter("roots > 1"), "token"))
    a = mixed.filter("root <> main").select("token", *[F.col(c).alias(f"a_{c}") for c in ("gid", "root", "n", "place")])
    b = mixed.select("token", "main", *[F.col(c).alias(f"b_{c}") for c in ("gid", "root", "n", "place")])
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    left = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    fits = (
        (F.col("a_root") != F.col("b_root"))
        & ((F.col("b_root") == F.col("main")) | (F.col("a_root") < F.col("b_root")))
        & (100 * small >= percent * large)
        & ((100 + percent) * left >= percent * (F.col("a_n") + F.col("b_n")))
    )
    pairs = a.join(b, "token").filter(fits).select("a_gid", "a_root", "b_gid", "b_root").distinct()
    side = lambda c, out: placed.select(F.col("gid").alias(f"{c}_gid"), F.col("root").alias(f"{c}_root"), F.col("sid").alias(out))
    expanded = pairs.join(side("a", "u"), ["a_gid", "a_root"]).join(side("b", "v"), ["b_gid", "b_root"])
    return expanded.select("u", "v")


def similar_documents(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    A text's set holds its distinct shingles of ``width`` words (A-Z lower-cased,
    split at ASCII white space); fewer words are one shingle, none make an empty
    set, linked with nothing. Two rows are linked if their intersection is at least
    ``percent`` of their union; component_id is the smallest doc_id reachable. Null
    counts as empty; a row with a null doc_id links others and names a component
    only if all its rows are null. Repeated rows stay. Other columns are ignored;
    an empty table gives an empty result.

    Equal sets are one set from the start. A set takes part in the join only if
    enough of its shingles occur elsewhere for its prefix to hold one of them.
    """
    base = staged(sets_of(docs, width))
    distinct = base.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("first_doc"))
    distinct = staged(distinct.withColumn("sid", F.lower(F.hex("digest"))))
    total = base.agg(F.sum("n")).first()[0] or 0
    links = _links(docs, distinct, width, percent, max(LEAST_PARTS, -(-total // PART)))
    roots = connected_components(links, "u", "v")
    rooted = distinct.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "digest", "n", "first_doc", F.coalesce("root", "sid").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    component = rooted.join(named, "root").select("digest", "n", "component_id")
    return base.join(component, ["digest", "n"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _links(docs: DataFrame, distinct: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """Edges (u, v) between sets whose components are those of all linked pairs."""
    # a set as large as this can miss a shingle of a linked one
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 31
    named = distinct.filter(F.col("n") >= least).withColumn(
        "name", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    )
    shared = shared_counts(docs, width, parts)
    partners = named.join(shared, "name").filter(F.col("n_shared") > F.col("n") - prefix_size(F.col("n"), percent))
    partners = staged(partners.select("sid", "digest", "first_doc"))
    # rows are found by doc_id (null ones too) and told apart by their digest
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    wanted = partners.select(F.coalesce(F.col("first_doc").cast("string"), F.lit("")).alias("id")).distinct()
    texts = docs.select(ids.alias("id"), text_bytes().alias("text")).join(wanted, "id", "left_semi")
    sets = _members(texts, width).join(partners.select("digest", "sid"), "digest").groupBy("sid").agg(F.first("tokens").alias("tokens"))
    sets = staged(sets)
    groups, members = grouped(sets, percent)
    near = staged(verified(_to_leaders(groups, members, percent), sets, percent))
    roots = staged(connected_components(near, "u", "v"))
    return near.unionByName(verified(_across(groups, members, roots, percent), sets, percent))


JACCARD_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda w: w <> '') AS words
  FROM {documents}
), sets AS (
  SELECT row, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
           ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 1),
             lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) END AS shingles
  FROM texts
), folded AS (
  SELECT row_number() OVER () AS s, shingles, len(shingles) AS n, min(doc_id) AS first_doc FROM sets WHERE len(shingles) > 0 GROUP BY shingles
), tokens AS (
  SELECT s, n, unnest(shingles) AS shingle FROM folded
), links AS (
  SELECT a.s AS u, b.s AS v FROM tokens a JOIN tokens b ON a.shingle = b.shingle AND a.s < b.s AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.s, b.s, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT s AS start, s AS node FROM folded
  UNION
  SELECT r.start, e.v FROM reach r JOIN edges e ON e.u = r.node
), components AS (
  SELECT start AS s, min(first_doc) AS component_id FROM reach JOIN folded f ON f.s = node GROUP BY start
)
SELECT doc_id, CAST(len(sets.shingles) AS BIGINT) AS n_shingles,
       CASE WHEN len(sets.shingles) = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets LEFT JOIN folded f ON f.shingles = sets.shingles LEFT JOIN components USING (s)
"""
