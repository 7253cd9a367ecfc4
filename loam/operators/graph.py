"""Connected components and reachability as loops of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.storage import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the edges and the lowest node it is connected with.

    Each round takes the lowest label of the neighbours and then that label's own label, so
    that long chains shorten by half. The edges are computed once.
    """
    ways = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))
    both = written(edges.select(F.inline(ways)))
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("low"))
        low = labels.join(near, "node").select("node", "component", F.least("component", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        now = written(low.join(jump, "low", "left").select("node", "component", F.least("low", F.coalesce("further", "low")).alias("now")))
        moved = now.where("now <> component").limit(1).count()
        labels = now.select("node", F.col("now").alias("component"))
        if not moved:
            return labels


def reachable(edges: DataFrame, start: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node): all nodes on paths of any length from the start nodes (column node), the start itself among them.

    Breadth first: each round joins the frontier with the edges and takes out what was seen,
    so that cycles end and each edge is looked at once.
    """
    seen = written(start.select("node").distinct())
    frontier = seen
    while True:
        step = frontier.join(edges, frontier["node"] == edges[source]).select(F.col(target).alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = written(seen.unionByName(frontier))


def hops(edges: DataFrame, start: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """The distinct edges whose source is reachable from the start: one row for each step that a walk may take."""
    there = reachable(edges, start, source, target)
    return edges.join(there, edges[source] == there["node"], "left_semi").select(source, target).distinct()


