"""Connected components by alternating large-star and small-star.

Edges stay a distributed table of (node, smaller neighbour); each round joins
it with the least neighbour of every node, so a node with very many edges is
an aggregate with partial sums and a join that Spark can split, never a list.
Each round ends in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import drop, settle


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "less").cast("decimal(38,0)"))).first())


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that is not its component's least; no nulls, no loops needed.

    Pairs may repeat and come in either direction; pairs of equal nodes count for nothing; no pairs give no rows.
    """
    edges = settle(pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("less")).distinct(), "edges", few=True)
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("node", F.col("less").alias("other")).unionAll(edges.select(F.col("less").alias("node"), F.col("node").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.join(least, "node").where("other > node").select(F.col("other").alias("node"), F.col("least").alias("less")).distinct()
        least = large.groupBy("node").agg(F.min("less").alias("least"))
        moved = large.join(least, "node").where("less != least").select(F.col("less").alias("node"), F.col("least").alias("less"))
        old, edges = edges, settle(moved.unionAll(least.select("node", F.col("least").alias("less"))).distinct(), "edges", few=True)
        drop(old)
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select("node", F.col("less").alias("root"))
