"""Link-graph reachability (G1).

Everything reachable from the roots along local links; only expandable
nodes (pages, not images) are followed; self-links are ignored and visited
nodes are never expanded twice, so cycles end.  A frontier loop of joins
and anti joins: each round's visited set is checkpointed to the session's
checkpoint folder (lineage stays one round deep and survives executor
loss); the driver only tests whether the frontier is empty.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import cut_lineage


def reachable(edges: DataFrame, roots: DataFrame, expandable: DataFrame, max_rounds: int | None = None,
              checkpoint_every: int = 4) -> DataFrame:
    """edges(src, dst), roots(node), expandable(node) -> (node, depth) of every reachable node.

    The loop ends when a round finds nothing new.  A caller's ``max_rounds`` is
    a guard: a search that is not finished by then raises, it is never cut.
    """
    # the edge list and the expandable set are read every round: derive them once
    exp = expandable.select(F.col("node").alias("src")).distinct()
    e = cut_lineage(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct().join(exp, "src", "left_semi"))
    visited = cut_lineage(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in count(1):
        # one BFS level: an equi join with the edges of expandable nodes, a
        # distinct and an anti join against the visited set - no path pairs
        step = (frontier.join(e, F.col("node") == F.col("src"))
                .select(F.col("dst").alias("node")).distinct()
                .join(visited.select("node"), "node", "left_anti")
                .withColumn("depth", F.lit(depth)))
        # the frontier is materialised (it is tested for emptiness and reused);
        # the visited set is a union of materialised frontiers, cut every few rounds
        frontier = cut_lineage(step)
        if frontier.limit(1).count() == 0:
            return visited
        if max_rounds is not None and depth >= max_rounds:
            raise RuntimeError(f"reachability not finished after {max_rounds} rounds")
        visited = visited.unionByName(frontier)
        if depth % checkpoint_every == 0:
            visited = cut_lineage(visited)
