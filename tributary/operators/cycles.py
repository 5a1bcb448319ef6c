"""Which nodes lie on cycles: strongly connected components without a closure.

Nodes that have no edge in, or none out, are on no cycle; they are trimmed off round by round, which leaves nothing of an acyclic graph. What
is left is split by labels: every node takes the smallest label among the nodes that reach it, and the smallest among those that
it reaches. Where both are the same, the node reaches the label's owner and is reached by it: these nodes are the owner's component, found and
done. Inside any other component each of the two is equal for all nodes, so edges between different labels go, and the next pass works on what remains.
Labels prefer nodes with many edges in and out, which lie in large components, and are drawn anew in every pass. Tables are as large as
the remaining edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.fixpoint import GROUP, buckets, edge_table, least, small_graphs
from tributary.tables import cut, keep


#: Trimming goes on while it leaves at most this part.
WORTH = 0.9


def _inner(edges: DataFrame) -> DataFrame:
    """Edges whose source has an edge in and whose sink has an edge out."""
    into = edges.select(GROUP, F.col("dst").alias("src")).distinct()
    out = edges.select(GROUP, F.col("src").alias("dst")).distinct()
    return edges.join(into, [GROUP, "src"], "left_semi").join(out, [GROUP, "dst"], "left_semi").select(GROUP, "src", "dst")


def trimmed(edges: DataFrame, dealt: int = 0) -> tuple[DataFrame, int]:
    """The edges on cycles or on ways between them, hardly more, and their number."""
    edges, n, _ = cut(edges.select(GROUP, "src", "dst").filter("src <> dst").distinct(), dealt=dealt)
    if not dealt and small_graphs(edges, n):
        dealt = buckets(edges.sparkSession, n)
        edges = keep(edges, dealt)
    before = None
    while n and (before is None or n < WORTH * before):
        before = n
        edges, n, _ = cut(_inner(_inner(edges)), dealt=dealt)
    return edges, n


def _labelled(edges: DataFrame, turn: int) -> DataFrame:
    """(func_id, node, ahead, behind): smallest label that reaches a node, and that it reaches."""
    ends = edges.select(GROUP, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("e"))
    nodes = ends.groupBy(GROUP, F.col("e.node").alias("node")).agg((-F.sum("e.o") * F.sum(1 - F.col("e.o"))).alias("w"))
    nodes = nodes.withColumn("label", F.struct("w", F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("n")))
    # both directions in one run: a graph and its reverse side by side
    def at(side: int, node: str, name: str):
        return F.struct(F.lit(side).alias("side"), F.col(node).alias("node")).alias(name)

    sides_of = F.explode(F.array(F.struct(at(0, "src", "src"), at(0, "dst", "dst")), F.struct(at(1, "dst", "src"), at(1, "src", "dst")))).alias("e")
    both = edges.select(GROUP, sides_of).select(GROUP, "e.src", "e.dst")
    start = nodes.select(GROUP, F.explode(F.array(at(0, "node", "node"), at(1, "node", "node"))).alias("node"), "label")
    found = least(edge_table(both, edges), start).select(GROUP, "node.node", "node.side", "label")
    sides = [F.max(F.when(F.col("side") == i, F.col("label"))).alias(n) for i, n in enumerate(("ahead", "behind"))]
    return keep(found.groupBy(GROUP, "node").agg(*sides), getattr(edges, "_dealt", 0))


def strong_components(edges: DataFrame, dealt: int = 0) -> DataFrame:
    """(func_id, node, component): the nodes on cycles, self-loops included; a component is named by its smallest node."""
    alone = edges.filter("src = dst").select(GROUP, F.col("src").alias("node")).distinct()
    inside, n = trimmed(edges, dealt)
    turn, done = 0, None
    while n:
        labels = _labelled(inside, turn)
        owned = labels.filter("ahead = behind").select(GROUP, "node", "ahead")
        names = owned.groupBy(GROUP, "ahead").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = owned.join(names, [GROUP, "ahead"]).select(GROUP, "node", "component")
        dealt = getattr(inside, "_dealt", 0)
        done = keep(found if done is None else done.unionByName(found), dealt)
        labels = labels.filter("ahead <> behind")
        a = labels.select(GROUP, F.col("node").alias("src"), F.col("ahead").alias("a1"), F.col("behind").alias("b1"))
        b = labels.select(GROUP, F.col("node").alias("dst"), F.col("ahead").alias("a2"), F.col("behind").alias("b2"))
        inside, n = trimmed(inside.join(a, [GROUP, "src"]).join(b, [GROUP, "dst"]).filter("a1 = a2 AND b1 = b2"), dealt)
        turn += 1
    if done is None:
        return alone.withColumn("component", F.col("node"))
    return done.unionByName(alone.join(done, [GROUP, "node"], "left_anti").withColumn("component", F.col("node")))
