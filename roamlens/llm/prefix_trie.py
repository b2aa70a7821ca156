"""Prefix trie of conversations by van Emde Boas recursion, as joins and aggregates.

Sequences are cut at half depth. The upper half gets a name, which is the scope of
the lower half; upper tries and lower forests are cut again, all scopes at once,
until pieces are single turns. Names of pieces never leave a conversation, so only
nodes, their totals and the members' ids are shuffled by name. Then the totals of
the lower forests are grafted onto the upper tries, from the smallest pieces up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from roamlens.llm.common import staged
from roamlens.operators.ordered import blocked_row_number

# Turns of a chunk: pieces up to this size are cut inside a row, larger ones by joins.
CHUNK_BITS = 6
CHUNK = 1 << CHUNK_BITS
# Ids of members written as one string before strings of a node are hashed.
RUN = 4096
ROOT = "00" * 16


def _name(data: Column) -> Column:
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def _join(scope: Column, inner: Column) -> Column:
    """Name of a sequence cut in two: from the name of its upper part and of its lower one."""
    return _name(F.concat(scope, inner))


def turn_names(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, name, n_bytes): role and text as a 128-bit digest, null ones as empty.

    Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        _name(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("name"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, name, n_bytes) in the order of ``turn``, null first, ties by name.

    The table is cut into ranges of (conv_id, turn, name), so a conversation of any
    length is numbered in bounded blocks; equal rows may be cut anywhere.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("name")]
    spread = turns.withColumn("any", F.monotonically_increasing_id())
    ranges = staged(
        spread.repartitionByRange(*order, F.col("any")).withColumn("block", F.spark_partition_id()).drop("any")
    )
    rows = blocked_row_number(ranges, ["conv_id"], order[1:], F.col("block"), "pos")
    return rows.select("conv_id", (F.col("pos") - 1).cast("long").alias("pos"), "name", "n_bytes")


def regrown(turns: DataFrame, family: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: (turns, conversations).

    Conversation c takes the first h turns of conversation c - c % family (all if
    it has fewer, none if it doesn't exist), then its own turns after its first h,
    where h = crc32(c in decimal) % modulus. ``turns`` as ``numbered`` gives them.
    """
    own = staged(turns)
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(modulus))
    convs = lengths.select(
        "conv_id", "n", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    )
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = staged(convs.join(base, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0)))))
    opening = own.filter(F.col("pos") < modulus).withColumnRenamed("conv_id", "base")
    shared = opening.join(convs.select("conv_id", "base", "h"), "base").filter("pos < h")
    rest = own.join(convs.select("conv_id", "h", "head"), "conv_id").filter("pos >= h")
    grown = shared.select("conv_id", "pos", "name", "n_bytes").unionByName(
        rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "name", "n_bytes")
    )
    return grown, convs.select("conv_id")


def _lower_named(k: int):
    """One round over the places of a chunk: a piece of 2^(k+1) turns is cut in half,
    and names in its lower half get the name of its upper half as their scope."""

    def named(x: Column, i: Column) -> Column:
        upper = F.get("inside", F.shiftleft(F.shiftright(i, k), k) - 1)
        return F.when(i.bitwiseAND(F.lit(1 << k)) != 0, _join(upper, x)).otherwise(x)

    return named


def _named_inside(chunks: DataFrame) -> DataFrame:
    """Names of all prefixes of every chunk."""
    for k in range(CHUNK_BITS):
        chunks = chunks.withColumn("inside", F.transform("inside", _lower_named(k)))
    return chunks


def _scopes(chunks: DataFrame, top: int) -> DataFrame:
    """(conv_id, chunk, scope): the name of all turns before the chunk.

    Blocks of 2^k whole chunks are named upwards; then every prefix of an odd
    number of blocks is cut at the name of the prefix without its last block.
    Both walks halve or double the number of rows per step.
    """
    full = chunks.filter(F.size("inside") == CHUNK).select("conv_id", "chunk", F.element_at("inside", -1).alias("name"))
    blocks = [staged(full)]
    while (1 << len(blocks)) <= top:
        two = blocks[-1].groupBy("conv_id", F.shiftright("chunk", 1).alias("half")).agg(
            F.min_by("name", "chunk").alias("a"), F.max_by("name", "chunk").alias("b"), F.count("*").alias("n")
        )
        blocks.append(staged(two.filter("n = 2").select("conv_id", F.col("half").alias("chunk"), _join(F.col("a"), F.col("b")).alias("name"))))
    root = F.unhex(F.lit(ROOT))
    scopes = staged(chunks.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("chunk"), root.alias("scope")))
    for k in reversed(range(len(blocks))):
        upper = blocks[k].filter("chunk % 2 = 0").join(
            scopes.select("conv_id", F.shiftright("chunk", k).alias("chunk"), "scope"), ["conv_id", "chunk"]
        )
        added = upper.select(
            "conv_id", F.shiftleft(F.col("chunk") + 1, k).alias("chunk"), _join(F.col("scope"), F.col("name")).alias("scope")
        )
        scopes = staged(scopes.unionByName(added))
    return scopes


def prefix_names(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, name, parent, n_bytes, last): one row per conversation and
    prefix, from depth 0. Equal prefixes, and no others, have equal names."""
    turn = F.struct("pos", "name", "n_bytes")
    chunks = turns.groupBy("conv_id", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    ).select("conv_id", "chunk", F.col("turns.name").alias("inside"), F.col("turns.n_bytes").alias("n_bytes"))
    chunks = staged(_named_inside(chunks))
    top = chunks.agg(F.max("chunk")).first()[0]
    root = F.unhex(F.lit(ROOT))
    if top:
        scopes = _scopes(chunks, top)
        after = scopes.select("conv_id", (F.col("chunk") - 1).alias("chunk"), F.col("scope").alias("whole"))
        scoped = chunks.join(scopes, ["conv_id", "chunk"]).join(after, ["conv_id", "chunk"], "left")
    else:
        scoped = chunks.withColumn("scope", root).withColumn("whole", F.lit(None).cast("binary"))
    # the prefix that ends with a chunk is the scope of the next one
    names = F.transform(
        "inside", lambda x, i: F.when((i == CHUNK - 1) & F.col("whole").isNotNull(), F.col("whole")).otherwise(_join(F.col("scope"), x))
    )
    named = scoped.withColumn("names", names).select("conv_id", "chunk", "scope", "names", "n_bytes", F.posexplode("names").alias("i", "name"))
    deep = named.select(
        "conv_id", (F.shiftleft("chunk", CHUNK_BITS) + F.col("i") + 1).cast("long").alias("depth"), "name",
        F.coalesce(F.get("names", F.col("i") - 1), F.col("scope")).alias("parent"), F.get("n_bytes", "i").alias("n_bytes"),
    )
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    tops = convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), root.alias("name"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("n_bytes"),
    )
    return deep.unionByName(tops).join(lengths, "conv_id", "left").select(
        "conv_id", "depth", "name", "parent", "n_bytes", (F.col("depth") == F.coalesce("length", F.lit(0))).alias("last")
    )


def _grafted(nodes: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
    """(name, n_leaves, saved_tokens) of whole subtrees.

    Depths are cut into pieces of 2, 4, 8 … levels. In each round the totals of a
    lower forest are summed on the node it hangs on, the last of its upper trie,
    and added to the nodes of the upper trie above it, found on the path of the
    smallest member. A forest of 2^k levels meets 2^k nodes, so a round handles
    at most as many rows as there are nodes.
    """
    totals = nodes.select(
        "name", "parent", "depth", "conv_id", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    for k in range(deepest.bit_length()):
        half = 1 << k
        hung = totals.filter(F.col("depth") % (2 * half) == half).groupBy("parent").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        cut = totals.select(F.col("name").alias("parent"), "depth", "conv_id").filter(F.col("depth") % (2 * half) == half - 1)
        reached = hung.join(cut, "parent").select(
            "conv_id", "leaves", "saved", F.explode(F.sequence(F.col("depth") - (half - 1), F.col("depth"))).alias("depth")
        )
        if half == 1:
            above = hung.withColumnRenamed("parent", "name")
        else:
            above = reached.join(paths, ["conv_id", "depth"]).groupBy("name").agg(
                F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
            )
        above = above.select("name", F.col("leaves").alias("more"), F.col("saved").alias("more_saved"))
        totals = staged(totals.join(above, "name", "left").select(
            "name", "parent", "depth", "conv_id", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        ))
    return totals.select("name", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv_id) rows as (name, first, ids): up to RUN ids comma-joined."""

    def out(name, ids):
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["name", "first", "ids"])

    name, ids = None, []
    for batch in batches:
        for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != name or len(ids) == RUN:
                if ids:
                    yield out(name, ids)
                name, ids = n, []
            ids.append(i)
    if ids:
        yield out(name, ids)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the runs of each name, one run in memory at a time."""
    name, digest = None, None
    for batch in batches:
        names, hashes = [], []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n == name:
                digest.update(b"," + ids.encode())
                continue
            if name is not None:
                names.append(name)
                hashes.append(digest.hexdigest())
            name, digest = n, hashlib.sha256(ids.encode())
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes)], ["name", "ends_sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], ["name", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id): ids in numeric order, comma-joined, hashed.

    Ranges of (name, conv_id) write strings of up to ``RUN`` ids each, so that the
    one chain a digest is computed in only reads ready strings."""
    ranges = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    runs = staged(ranges.mapInArrow(_runs, "name BINARY, first LONG, ids STRING"))
    dealt = runs.repartition(F.col("name")).sortWithinPartitions("name", "first").select("name", "ids")
    return dealt.mapInArrow(_hashed, "name BINARY, ends_sha256 STRING")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``convs`` (distinct conv_id) and their ``turns``
    (conv_id, pos from 0 without gaps, name, n_bytes).

    One row per distinct prefix: name (16 bytes; the root's are zero), parent, depth,
    conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens of the subtree, ends_sha256 (members that end here, see
    ``ends_digests``; without any the hash of the empty string). Conversations
    without turns are members of the root only; no conversations give no nodes.
    """
    paths = staged(prefix_names(turns, convs))
    grouped = paths.groupBy("name").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"),
        F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"),
    )
    grouped = staged(grouped)
    children = grouped.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = staged(grouped.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = _grafted(nodes, paths.select("conv_id", "depth", "name"), deepest)
    ends = ends_digests(paths.filter("last"))
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(totals, "name").join(ends, "name", "left").join(parents, "parent", "left").select(
        "name", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the regrown ``conversations`` (conv_id, turn, role, text); see ``regrown``.

    Null role or text counts as empty; a null turn comes first, ties are ordered by
    a digest of role and text, repeated rows are turns of their own. Rows with a null
    conv_id are no conversation. Texts may be of any length: only digests and byte
    counts of them travel. Other columns are ignored.
    """
    return prefix_trie(*regrown(numbered(turn_names(conversations))))


TRIE_SQL = """
WITH named AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS n_bytes,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM {conversations} WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, key, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM named
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
             lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), grown AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.key, o.n_bytes FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.key, o.n_bytes FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h
), lists AS (
  SELECT c.conv_id, coalesce(list(g.key ORDER BY part, pos) FILTER (g.key IS NOT NULL), []) AS keys,
         coalesce(list(g.n_bytes ORDER BY part, pos) FILTER (g.key IS NOT NULL), []) AS sizes
  FROM convs c LEFT JOIN grown g USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, d AS depth, keys[1:d] AS prefix, coalesce(sizes[d], 0) AS n_bytes, d = len(keys) AS last
  FROM lists, unnest(range(0, len(keys) + 1)) AS u(d)
), nodes AS (
  SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix
), children AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (prefix)
), above AS (
  SELECT prefix[1:d] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved
  FROM full_nodes, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
       CAST(a.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN above a USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
"""
