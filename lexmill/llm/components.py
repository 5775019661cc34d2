"""Connected components of a graph given by its edges, by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _roots(parents: DataFrame) -> DataFrame:
    """(node, parent) with each parent replaced by the last one up its chain; the chain's length halves each time."""
    parents = staged(parents, "parents")
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        once = parents.join(up, "parent").select("node", F.col("parent").alias("was"), F.col("grand").alias("parent"))
        jumped = staged(once, "parents")
        if not _any(jumped.filter("parent <> was")):
            return jumped.select("node", "parent")
        parents = jumped.select("node", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Each round hooks every node to the smallest of its neighbours and itself, follows the hooks to their roots and
    contracts the edges to the roots; at least half of the nodes that still have edges go. Only joins and partial
    aggregates on node ids are used, so a node with very many edges is spread over tasks. Null ends are not edges;
    self-loops and repeated edges change nothing; no edges give an empty result.
    """
    left = staged(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "edges")
    found: DataFrame | None = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("least"))
        parents = _roots(hooks.select(F.col("a").alias("node"), F.least("a", "least").alias("parent")))
        if found is None:
            found = parents.withColumnRenamed("parent", "component")
        else:
            moved = parents.select(F.col("node").alias("component"), F.col("parent").alias("to"))
            found = found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        rest = left.join(a, "a").join(b, "b").filter("pa <> pb")
        left = staged(rest.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if not _any(left):
            return found
        found = staged(found, "components")
