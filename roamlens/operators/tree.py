"""Space and class trees: reach, preorder labels, rollups along fixed flows.

Pairs of a node and what lies above or below it grow from the asked nodes only.
A tree of a few thousand nodes is read once and walked on the driver; a larger one
grows its frontier by steps of doubling length, whose tables hold at most one row
per node, so a chain of any length costs a logarithm of joins of its own size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roamlens.functions.times import ts
from roamlens.operators.bins import explode_bins
from roamlens.functions.times import slot_start
from roamlens.session import durable, sized_broadcast

# Nodes, and pairs of nodes, up to which a tree is walked on the driver.
LOCAL_NODES, LOCAL_PAIRS = 10_000, 100_000
CYCLE = "the parents form a cycle"


def _edges(tree: DataFrame, node: str, parent: str, inner: bool = False) -> DataFrame:
    """(node, parent); with ``inner`` only parents that are nodes themselves count."""
    edges = tree.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    if not inner:
        return edges
    known = edges.select(F.col("node").alias("parent"), F.lit(True).alias("_known")).distinct()
    return edges.join(known, "parent", "left").select("node", F.when(F.col("_known"), F.col("parent")).alias("parent"))


def _walked(edges: DataFrame) -> list[tuple] | None:
    """(descendant, ancestor, depth) of a small tree, or None if it is larger."""
    rows = edges.where("node IS NOT NULL").limit(LOCAL_NODES + 1).collect()
    if len(rows) > LOCAL_NODES:
        return None
    above: dict = {}
    for r in rows:
        above.setdefault(r["node"], []).append(r["parent"])
    pairs = []
    for r in rows:
        reached, depth = [r["node"]], 0
        while reached:
            if depth > len(rows):
                raise ValueError(CYCLE)
            pairs += [(r["node"], up, depth) for up in reached]
            if len(pairs) > LOCAL_PAIRS:
                return None
            reached = [p for up in reached for p in above.get(up, []) if p is not None]
            depth += 1
    return pairs


def _reach(edges: DataFrame, starts: DataFrame, down: bool = False) -> DataFrame:
    """(descendant, ancestor, depth) from every row of ``starts`` (node), itself included.

    Semi-naive: in round k only the pairs found so far are carried on by the table
    of steps of 2^k, which grows by joining itself; the search ends with the
    first round that reaches nothing. A step longer than the number of edges means
    a cycle and is an error.
    """
    start, end = ("ancestor", "descendant") if down else ("descendant", "ancestor")
    pairs = _walked(edges)
    if pairs is not None:
        schema = f"descendant {edges.schema['node'].dataType.simpleString()}, ancestor {edges.schema['node'].dataType.simpleString()}, depth INT"
        local = F.broadcast(edges.sparkSession.createDataFrame(pairs, schema))
        return starts.select(F.col("node").alias(start)).join(local, start).select("descendant", "ancestor", "depth")
    at, to = ("parent", "node") if down else ("node", "parent")
    step = durable(edges.where("node IS NOT NULL AND parent IS NOT NULL").select(F.col(at).alias("_at"), F.col(to).alias("_to")))
    n_edges, length = step.count(), 1
    starts = starts.join(edges.select("node").distinct(), "node", "left_semi")
    pairs = durable(starts.select(F.col("node").alias(start), F.col("node").alias(end), F.lit(0).alias("depth")))
    while True:
        further = durable(pairs.join(step, F.col(end) == F.col("_at")).select(
            start, F.col("_to").alias(end), (F.col("depth") + length).alias("depth")
        ))
        if further.isEmpty():
            return pairs.select("descendant", "ancestor", "depth")
        if length > n_edges:
            raise ValueError(CYCLE)
        pairs = durable(pairs.unionByName(further))
        step = durable(step.join(step.select(F.col("_at").alias("_to"), F.col("_to").alias("_next")), "_to").select("_at", F.col("_next").alias("_to")))
        length *= 2


def closure(tree: DataFrame, node: str = "space_id", parent: str = "parent_space_id") -> DataFrame:
    """(descendant, ancestor, depth) with every node its own ancestor at 0, at any depth."""
    edges = _edges(tree, node, parent)
    return _reach(edges, edges)


def _asked(tree: DataFrame, asked, node: str) -> DataFrame:
    return tree.where(F.col(node) == F.lit(asked)).select(F.col(node).alias("node"))


def descendants(tree: DataFrame, root: int, node: str = "space_id", parent: str = "parent_space_id") -> DataFrame:
    """Nodes at or below ``root`` with their distance."""
    found = _reach(_edges(tree, node, parent), _asked(tree, root, node), down=True)
    return found.select(F.col("descendant").alias(node), "depth")


def ancestors(tree: DataFrame, start: int, node: str = "space_id", parent: str = "parent_space_id") -> DataFrame:
    """Nodes at or above ``start`` with their distance; a parent that is no node is left out."""
    found = _reach(_edges(tree, node, parent, inner=True), _asked(tree, start, node))
    return found.select(F.col("ancestor").alias(node), "depth")


def preorder(tree: DataFrame, node: str = "space_id", parent: str = "parent_space_id") -> DataFrame:
    """(node, depth, first, last): places of a walk from above, children by their id.

    x lies at or below r exactly if r.first <= x.first <= r.last, so the subtrees
    of any number of nodes are range tests (``in_subtree``). Roots are walked one
    after the other by id; a parent that is no node makes a root. Sizes of subtrees
    and places of children are added up over steps of doubling length: a logarithm
    of the depth in joins, none of them larger than the tree.
    """
    edges = durable(_edges(tree, node, parent, inner=True).where("node IS NOT NULL"))
    n = edges.count()
    step = edges.where("parent IS NOT NULL").select("node", F.col("parent").alias("up"))
    state = edges.select("node", F.lit(1).cast("long").alias("size"), F.lit(0).alias("depth"))
    steps, length = [], 1
    while not step.isEmpty():
        if length > n:
            raise ValueError(CYCLE)
        steps.append(step)
        below = step.join(state, "node").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("_more"))
        near = step.join(state.select(F.col("node").alias("up"), F.col("depth").alias("_depth")), "up").select("node", "_depth")
        state = durable(state.join(below, "node", "left").join(near, "node", "left").select(
            "node", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"),
            F.when(F.col("_depth").isNull(), F.col("depth")).otherwise(F.col("_depth") + length).alias("depth"),
        ))
        on = step.select(F.col("node").alias("up"), F.col("up").alias("_next"))
        step = durable(step.join(on, "up").select("node", F.col("_next").alias("up")))
        length *= 2
    elder = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed = edges.join(state, "node").select(
        "node", "size", "depth",
        (F.coalesce(F.sum("size").over(elder), F.lit(0)) + F.col("parent").isNotNull().cast("long")).alias("first"),
    )
    placed = durable(placed)
    for step in steps:  # a place is the sum of the places among siblings on the way up
        above = step.join(placed.select(F.col("node").alias("up"), F.col("first").alias("_above")), "up").select("node", "_above")
        placed = durable(placed.join(above, "node", "left").select(
            "node", "size", "depth", (F.col("first") + F.coalesce("_above", F.lit(0))).alias("first")
        ))
    return placed.select(F.col("node").alias(node), "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def in_subtree(labels: DataFrame, root, node: str = "space_id") -> DataFrame:
    """Nodes at or below ``root`` as a range test on the labels of :func:`preorder`."""
    found = labels.where(F.col(node) == F.lit(root)).select("first", "last", "depth").first()
    if found is None:
        return labels.select(node, "depth").limit(0)
    return labels.where(F.col("first").between(found["first"], found["last"])).select(node, (F.col("depth") - found["depth"]).alias("depth"))


def children(tree: DataFrame, of: int, parent: str = "parent_space_id") -> DataFrame:
    return tree.where(F.col(parent) == F.lit(of))


def roots(tree: DataFrame, parent: str = "parent_space_id") -> DataFrame:
    return tree.where(F.col(parent).isNull())


def time_bounds(s: DataFrame, tree: DataFrame, root: int) -> DataFrame:
    """First start and last end of the sessions in a subtree."""
    return s.join(sized_broadcast(descendants(tree, root).select("space_id")), "space_id", "left_semi").agg(
        F.min("start_time").alias("min_time"), F.max("end_time").alias("max_time")
    )


def classify_spaces(tree: DataFrame, s: DataFrame, root: int, start, end) -> DataFrame:
    """(space_id, space_type): 'source' has sessions overlapping the window,
    'derived' is an ancestor of a source inside the subtree; source wins."""
    inside = descendants(tree, root).select("space_id")
    busy = (
        s.where((F.col("start_time") < ts(end)) & (F.col("end_time") > ts(start)))
        .select("space_id").distinct()
        .join(inside, "space_id", "left_semi")
    )
    up = _reach(_edges(tree, "space_id", "parent_space_id"), busy.withColumnRenamed("space_id", "node"))
    derived = up.where("depth > 0").select(F.col("ancestor").alias("space_id")).distinct().join(
        inside, "space_id", "left_semi"
    )
    both = busy.withColumn("_rank", F.lit(0)).unionByName(derived.withColumn("_rank", F.lit(1)))
    return both.groupBy("space_id").agg(F.min("_rank").alias("_rank")).select(
        "space_id", F.when(F.col("_rank") == 0, "source").otherwise("derived").alias("space_type")
    )


def source_flows(tree: DataFrame, sources: DataFrame) -> DataFrame:
    """(space_id, target): where the bins of a source space are counted.

    Itself, and every ancestor below its nearest ancestor that is a source
    too: a source keeps its own count and masks what lies under it.
    """
    src = sources.select("space_id").distinct()
    up = _reach(_edges(tree, "space_id", "parent_space_id"), src.withColumnRenamed("space_id", "node"))
    barrier = (
        up.where("depth > 0")
        .join(src.withColumnRenamed("space_id", "ancestor"), "ancestor", "left_semi")
        .groupBy("descendant").agg(F.min("depth").alias("_stop"))
    )
    return (
        up.join(barrier, "descendant", "left")
        .where("depth = 0 OR _stop IS NULL OR depth < _stop")
        .select(F.col("descendant").alias("space_id"), F.col("ancestor").alias("target"))
    )


def rollup_tree(bins: DataFrame, tree: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts of every space: own bins for sources, sums of children above.

    ``sources`` (space_id) are all spaces that have sessions in the dataset, not
    only in ``bins``: which spaces are masked must not depend on the days at hand.
    One join with the flows and one aggregate instead of a pass per depth. A device
    seen in two rooms counts twice above them.
    """
    return (
        bins.join(source_flows(tree, sources), "space_id")
        .groupBy(F.col("target").alias("space_id"), "interval_begin_time")
        .agg(F.sum("number_connections").alias("number_connections"))
    )


BIN = ["space_id", "interval_begin_time"]


def bin_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(space_id, interval_begin_time, change) of the bins whose counts differ; an absent bin is 0."""
    signed = new.select(*BIN, F.col("number_connections").alias("change")).unionByName(
        old.select(*BIN, (-F.col("number_connections")).alias("change"))
    )
    return signed.groupBy(*BIN).agg(F.sum("change").alias("change")).where("change <> 0")


def flow_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(space_id, target, sign): flows that came (+1) or went (-1) with new sources."""
    signed = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
    return signed.groupBy("space_id", "target").agg(F.sum("sign").alias("sign")).where("sign <> 0")


def delta_rollup(changes: DataFrame, flows: DataFrame, moved: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Changes of every space's count from signed changes of source bins.

    Sums are linear in the bins: a change runs along the same ``flows`` as its bin.
    Where the set of sources has grown, ``moved`` (``flow_changes``) takes the
    ``stored`` bins of the spaces concerned from where they were counted to where
    they are counted now.
    """
    parts = changes.join(flows, "space_id").select("target", "interval_begin_time", "change")
    if moved is not None:
        shifted = stored.join(moved, "space_id").select(
            "target", "interval_begin_time", (F.col("number_connections") * F.col("sign")).alias("change")
        )
        parts = parts.unionByName(shifted)
    return parts.groupBy(F.col("target").alias("space_id"), "interval_begin_time").agg(
        F.sum("change").alias("change")
    ).where("change <> 0")


def distinct_rollup(s: DataFrame, tree: DataFrame, interval_s: int, start=None, end=None) -> DataFrame:
    """Distinct devices per (subtree, bin); a device in two rooms counts once.

    Devices are made unique per (room, bin) before the closure join.
    """
    up = sized_broadcast(closure(tree).select(F.col("descendant").alias("space_id"), "ancestor"))
    seen = explode_bins(
        s.select("space_id", "mac_address", "start_time", "end_time"), interval_s, start, end
    ).select("space_id", "slot", "mac_address").distinct()
    return (
        seen.join(up, "space_id").groupBy("ancestor", "slot")
        .agg(F.count_distinct("mac_address").alias("number_connections"))
        .where("number_connections > 0")
        .select(
            F.col("ancestor").alias("space_id"),
            slot_start("slot", interval_s).alias("interval_begin_time"),
            "number_connections",
        )
    )
