"""Connected components by alternating large and small stars, on edges kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, table, with_sums


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the least neighbour of a; a hub's edges are spread by their other end."""
    return with_sums(edges, ["a"], F.col("b"), {"m": (F.min("b"), F.min)})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: two columns of one integer type, in any direction. Returns (node, root) for every node of an edge
    whose root is smaller than itself; nodes that are missing are their own roots. Edges with a null end, loops and
    repeated edges change nothing; no edges give no rows.

    Each round ends in a written table, and the one before is deleted. A node with many edges is dealt to parts by
    their other ends, both for its least neighbour and for telling the edges, so no task meets a whole hub."""
    a, b = edges.columns
    links = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    links = table(links, "links")
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        met = _with_least(large)
        small = met.select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b")
        before, links = links, table(small.distinct(), "links")
        forget(before)
        state = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
