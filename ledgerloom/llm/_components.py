"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.store import discard, stash


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row.n, row.h or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(u, v) that isn't its component's least; component is the least node.

    Each half of a round is written to the shared folder: a node's many edges are combined
    before they are shuffled for its least neighbour, and the join of the edges with
    the written least neighbours shuffles both sides anew, so that it is split where a node
    has a large share of the edges. A round's tables are removed once the next one's are
    written. The number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stash(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = stash(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old, first, least)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
