"""Connected components of a large edge table by repeated hooking and contraction.

Each round hooks every node to its smallest neighbour, follows those links to their roots, and replaces
nodes by roots. At least half of the nodes that still have an edge vanish per round, so the number of
rounds is logarithmic; each round is a few joins over what is left, written to the shared folder. The hub
of a large component is a hot key of these joins: its rows are dealt over salts (``split_join``). Folders
of earlier rounds are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, materialise, split_join


def _contracted(edges: DataFrame) -> DataFrame:
    """Each edge once, larger end first, without loops."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return materialise(ends.where("a > b").distinct(), "edges")


def _roots(parents: DataFrame) -> DataFrame:
    """Follow node -> parent to the end by doubling; parents are smaller than their nodes. ``parents`` is on disk."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        joined = split_join(parents.select("node", "parent"), up, "parent", "node", "left")
        doubled = materialise(joined.select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "roots")
        discard(parents)
        parents = doubled
        if doubled.where("moved").isEmpty():
            return parents.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: longs), the root being the smallest node of its component."""
    edges = _contracted(edges)
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialise(ends.select("node", F.col("node").alias("root")), "labels")
    while not edges.isEmpty():
        hooked = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        parents = _roots(materialise(hooked, "hooks"))
        up = parents.select(F.col("node").alias("root"), F.col("parent").alias("top"))
        before, labels = labels, materialise(split_join(labels, up, "root", "node", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        half = materialise(split_join(edges, left, "a", "b", "left").select(F.coalesce("ra", "a").alias("a"), "b"), "halves")
        both = split_join(half, right, "b", "a", "left").select("a", F.coalesce("rb", "b").alias("b"))
        done, edges = edges, _contracted(both)
        discard(before, done, half, parents)
    return labels
