"""Connected components by hooking and pointer jumping.

In each round every node takes its smallest smaller neighbour as parent. The parents form a forest,
whose trees are shortened to stars by jumps: a node's parent becomes its parent's parent. Edges are
then moved to the roots of their ends, and those that still lead to another root make the next
round. A root that gained no child has only smaller neighbours after that, so the number of roots
with edges halves in two rounds; edges that form a forest are done in one.

Every step is a minimum for each node, combined before the shuffle, or a join of stored tables with
one row a node. A node with very many edges is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstat.sources.scratch import stored

MAX_ROUNDS = 100  # far above twice the logarithm of any number of nodes, and above that of any depth


def _edges(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b), larger end first; null ends and loops are left out."""
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))


def _above(parents: DataFrame) -> DataFrame:
    return parents.select(F.col("node").alias("of"), F.col("root").alias("above"))


def to_roots(parents: DataFrame) -> DataFrame:
    """(node, root) of every node of a stored forest (node, root) of one parent a node."""
    for _ in range(MAX_ROUNDS):
        jumps = parents.join(_above(parents), F.col("root") == F.col("of"), "left").select(
            "node", F.coalesce("above", "root").alias("root"), F.col("of").isNotNull().alias("moved")
        )
        jumps = stored(jumps, "jumps")
        if jumps.where("moved").isEmpty():
            return parents
        parents = jumps.select("node", "root")
    raise RuntimeError("trees did not become stars")


def merged(component: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after ``more``, itself (node, root), has joined roots of ``component`` or further nodes."""
    moved = component.join(_above(more), F.col("root") == F.col("of"), "left")
    return moved.select("node", F.coalesce("above", "root").alias("root")).unionByName(more)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of a link (a, b) that is not its component's smallest.

    Null ends and links of a node with itself are left out; repeated links do not matter. The links
    are read twice, so they should be a stored table.
    """
    edges, found = _edges(links), None
    for _ in range(MAX_ROUNDS):
        least = stored(edges.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("most")), "parents")
        parents = to_roots(least.select("node", "root"))
        found = stored(merged(found, parents), "components") if found is not None else parents
        if least.where("root < most").isEmpty():  # every edge leads to a parent
            return found
        up, down = _above(parents), parents.select(F.col("node").alias("to"), F.col("root").alias("below"))
        moved = edges.join(up, F.col("node") == F.col("of"), "left").join(down, F.col("root") == F.col("to"), "left")
        ends = moved.select(F.coalesce("above", "node").alias("a"), F.coalesce("below", "root").alias("b"))
        edges = stored(_edges(ends).distinct(), "edges")
        if edges.isEmpty():
            return found
    raise RuntimeError("components did not settle")
