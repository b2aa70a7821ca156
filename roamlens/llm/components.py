"""Connected components of an edge table, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roamlens.llm.common import staged


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Alternates large-star (every greater neighbour is hung on the smallest one)
    and small-star (smaller neighbours likewise) until the edges stop changing:
    a logarithmic number of rounds, each one aggregate and one join, whose
    lineage ends in a staged table. A node of high degree is pre-aggregated and
    its join can be split. Edges with a null end and loops are ignored.
    """
    edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").distinct()
    edges = staged(edges)
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(low.withColumnRenamed("m", "v")).filter("u <> v").distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
