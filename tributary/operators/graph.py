"""Questions about graphs: who reaches whom, in how many steps, in which component, over which path.

``edges(func_id, src, dst)`` may hold duplicates. Node lists are ``(func_id, node)``. Nothing here collects a graph: a round is a join
on (func_id, node), so small graphs are answered side by side and a giant one is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.fixpoint import GROUP, closure, edge_table, hops, jump, propagate, with_stays  # noqa: F401 (closure is asked for here)
from tributary.operators import orders
from tributary.tables import cut, drop, keep, stored


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(GROUP, F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes_of(edges: DataFrame) -> DataFrame:
    ends = edges.select(GROUP, F.col("src").alias("node")).unionByName(edges.select(GROUP, F.col("dst").alias("node")))
    return ends.distinct()


def reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(func_id, node, depth): everything reachable from the sources, themselves at depth 0."""
    return propagate(sources, edge_table(edges), depth="depth")


def ancestors(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(func_id, node, depth): everything that reaches a target."""
    return reach(flipped(edges), targets)


def unreachable(edges: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that no root reaches."""
    return nodes.join(reach(edges, roots).drop("depth"), [GROUP, "node"], "left_anti")


def has_path(edges: DataFrame, pairs: DataFrame, no_edge: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """``pairs(func_id, src, dst)`` with ``found``. A node reaches itself, an unknown node neither reaches nor is reached.

    Known are the ends of edges, and ``nodes(func_id, node)`` where given. ``no_edge`` asks for a way besides the direct edge, that is, a simple path of two edges or more.
    """
    edges = edge_table(edges)
    asked = keep(pairs.select(GROUP, F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    if not no_edge:
        seed = asked.select(GROUP, F.col("a").alias("node"), "a").distinct()
        known = nodes_of(edges) if nodes is None else nodes_of(edges).unionByName(nodes.select(GROUP, "node"))
        seed = seed.join(known, [GROUP, "node"], "left_semi")
        got = propagate(seed, edges, tags=["a"]).withColumnRenamed("node", "b")
        return _answered(asked, got, ["a", "b"])
    first = asked.join(edges.withColumnRenamed("src", "a"), [GROUP, "a"]).filter("dst <> a AND dst <> b")
    seed = first.select(GROUP, F.col("dst").alias("node"), "a", "b").distinct()
    # the way goes on neither from its end nor through its start
    ends = asked.select(GROUP, F.col("a").alias("node"), "a", "b").unionByName(asked.select(GROUP, F.col("b").alias("node"), "a", "b"))
    got = propagate(seed, edges, tags=["a", "b"], stop=ends.distinct()).filter("node = b")
    return _answered(asked, got, ["a", "b"])


def _answered(asked: DataFrame, got: DataFrame, names: list[str]) -> DataFrame:
    got = got.select(GROUP, *names, F.lit(True).alias("found"))
    out = asked.join(got, [GROUP, *names], "left")
    return out.select(GROUP, F.col("a").alias("src"), F.col("b").alias("dst"), F.coalesce("found", F.lit(False)).alias("found"))


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(func_id, node, path): of the shortest paths from any source the lexicographically smallest, as an array."""
    edges = edge_table(edges)
    stays = with_stays(edges)
    spark = edges.sparkSession

    def hop(rows: DataFrame, along: DataFrame, known: DataFrame) -> DataFrame:
        step = rows.withColumnRenamed("node", "src").join(along, [GROUP, "src"])
        longer = F.when(F.col("src") == F.col("dst"), F.col("path")).otherwise(F.concat("path", F.array("dst")))
        step = step.select(GROUP, F.col("dst").alias("node"), F.struct(F.size(longer).alias("n"), longer.alias("path")).alias("p"))
        return step.groupBy(GROUP, "node").agg(F.min("p").getField("path").alias("path")).join(known, [GROUP, "node"], "left_anti")

    frontier, n, path = cut(sources.select(GROUP, "node").distinct().withColumn("path", F.array("node")))
    schema, paths = frontier.schema, [path]
    while n:
        known = stored(spark, schema, paths).select(GROUP, "node")
        found = hop(frontier, edges.filter("src <> dst"), known)
        for _ in range(hops(n) - 1):
            found = hop(found, stays, known)
        frontier, n, path = cut(found)
        paths.append(path)
    return stored(spark, schema, paths)


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(func_id, path): every path without a repeated node from a source to a target. Their number may be exponential."""
    edges = edge_table(edges)
    spark = edges.sparkSession
    # only nodes that still reach a target are worth a step
    useful = keep(ancestors(edges, targets).drop("depth"))
    edges = keep(edges.join(useful.withColumnRenamed("node", "dst"), [GROUP, "dst"], "left_semi"))
    frontier, n, path = cut(sources.select(GROUP, "node").distinct().withColumn("path", F.array("node")))
    schema, paths = frontier.schema, [path]
    hops = 0
    while n and (max_hops is None or hops < max_hops):
        hops += 1
        step = frontier.withColumnRenamed("node", "src").join(edges, [GROUP, "src"]).filter(~F.array_contains("path", F.col("dst")))
        frontier, n, path = cut(step.select(GROUP, F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        paths.append(path)
    return stored(spark, schema, paths).join(targets.select(GROUP, "node"), [GROUP, "node"], "left_semi").select(GROUP, "path")


def levels(edges: DataFrame) -> DataFrame:
    """(func_id, node, level): length of a longest path from a root; null for nodes on or behind a cycle."""
    edges = edge_table(edges)
    return orders.levels(edges, keep(nodes_of(edges), edges._dealt))


def is_acyclic(edges: DataFrame) -> DataFrame:
    """(func_id, acyclic)."""
    return levels(edges).groupBy(GROUP).agg((F.count(F.lit(1)) == F.count("level")).alias("acyclic"))


def reduce_dag(edges: DataFrame) -> DataFrame:
    """Edges of an acyclic graph that no longer path replaces."""
    edges = edge_table(edges)
    longer = orders.longer_ways(edges, keep(levels(edges)))
    return edges.join(longer.select(GROUP, F.col("a").alias("src"), F.col("b").alias("dst")), [GROUP, "src", "dst"], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(func_id, node, component): weakly connected components named by their smallest node.

    A round hooks every node to the smallest node next to it, follows these hooks to their end by pointer jumping and contracts the
    edges, so that the edge table shrinks with every round. The grouping by node combines before the shuffle, which keeps hubs harmless.
    """
    todo, n, _ = cut(edges.select(GROUP, "src", "dst").filter("src <> dst").distinct())
    alone = nodes_of(edges)
    label: DataFrame | None = None
    while n:
        last, old = todo, label
        both = todo.unionByName(flipped(todo))
        hook = both.groupBy(GROUP, F.col("src").alias("node")).agg(F.min("dst").alias("low"))
        jumped = jump(hook.select(GROUP, "node", F.least("node", "low").alias("parent")))
        hook = jumped.drop("steps")
        if label is None:
            label = keep(hook)
        else:
            up = hook.select(GROUP, F.col("node").alias("parent"), F.col("parent").alias("top"))
            label = keep(label.join(up, [GROUP, "parent"], "left").select(GROUP, "node", F.coalesce("top", "parent").alias("parent")))
        ends = hook.select(GROUP, F.col("node").alias("src"), F.col("parent").alias("a"))
        moved = todo.join(ends, [GROUP, "src"]).join(ends.toDF(GROUP, "dst", "b"), [GROUP, "dst"])
        moved = moved.filter("a <> b").select(GROUP, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        todo, n, _ = cut(moved)
        drop(last, jumped, *([] if old is None else [old]))
    if label is None:
        return alone.withColumn("component", F.col("node"))
    label = label.withColumnRenamed("parent", "component")
    return alone.join(label, [GROUP, "node"], "left").select(GROUP, "node", F.coalesce("component", "node").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    """(func_id, node, n_in, n_out, is_root, is_leaf, is_cross)."""
    ends = edges.select(GROUP, "src", "dst").distinct().select(
        GROUP, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("e")
    )
    out = ends.groupBy(GROUP, "e.node").agg(F.sum(1 - F.col("e.o")).alias("n_in"), F.sum("e.o").alias("n_out"))
    return out.select(
        "*", (F.col("n_in") == 0).alias("is_root"), (F.col("n_out") == 0).alias("is_leaf"), ((F.col("n_in") > 1) | (F.col("n_out") > 1)).alias("is_cross")
    )


def graph_slice(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Edges among the nodes that the sources reach and that reach a sink."""
    edges = edge_table(edges)
    inside = propagate(sources, edges).join(propagate(sinks, edge_table(flipped(edges))), [GROUP, "node"], "left_semi")
    return induced(edges, keep(inside))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    nodes = nodes.select(GROUP, "node")
    return edges.join(nodes.withColumnRenamed("node", "src"), [GROUP, "src"], "left_semi").join(
        nodes.withColumnRenamed("node", "dst"), [GROUP, "dst"], "left_semi"
    ).select(edges.columns)


def collapse(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(func_id, src, dst, n): nodes replaced by ``mapping(func_id, node, region)``, inner edges gone, parallel ones counted."""
    a = mapping.select(GROUP, F.col("node").alias("src"), F.col("region").alias("a"))
    b = mapping.select(GROUP, F.col("node").alias("dst"), F.col("region").alias("b"))
    out = edges.join(a, [GROUP, "src"], "left").join(b, [GROUP, "dst"], "left")
    out = out.select(GROUP, F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).filter("src <> dst")
    return out.groupBy(GROUP, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def chains(edges: DataFrame) -> DataFrame:
    """(func_id, node, start, pos): maximal runs of an acyclic graph; a run goes on where one successor has one predecessor."""
    edges = edge_table(edges)
    deg = keep(degrees(edges))
    single_out = deg.filter("n_out = 1").select(GROUP, F.col("node").alias("src"))
    single_in = deg.filter("n_in = 1").select(GROUP, F.col("node").alias("dst"))
    links = edges.join(single_out, [GROUP, "src"], "left_semi").join(single_in, [GROUP, "dst"], "left_semi")
    prev = deg.select(GROUP, "node").join(links.select(GROUP, F.col("dst").alias("node"), "src"), [GROUP, "node"], "left")
    runs = jump(prev.select(GROUP, "node", F.coalesce("src", "node").alias("parent")))
    return runs.select(GROUP, "node", F.col("parent").alias("start"), F.col("steps").alias("pos"))


def graph_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two node or edge tables that only one of them has, with ``side``; empty means equal graphs."""
    both = left.withColumn("_side", F.lit(0)).union(right.withColumn("_side", F.lit(1)))
    seen = both.groupBy(*left.columns).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high")).filter("_low = _high")
    return seen.select(*left.columns, F.when(F.col("_low") == 0, "left").otherwise("right").alias("side"))


def contract(pairs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undirected ``pairs(func_id, a, b)`` with every group replaced by its first member, and the pairs inside a group as conflicts."""
    first = groups.groupBy(GROUP, "grp").agg(F.min("node").alias("first"))
    named = keep(groups.join(first, [GROUP, "grp"]).select(GROUP, "node", "first"))
    out = pairs.join(named.toDF(GROUP, "a", "fa"), [GROUP, "a"], "left").join(named.toDF(GROUP, "b", "fb"), [GROUP, "b"], "left")
    out = keep(out.select(GROUP, "a", "b", F.coalesce("fa", "a").alias("x"), F.coalesce("fb", "b").alias("y")))
    conflicts = out.filter("x = y").select(GROUP, "a", "b")
    return out.filter("x <> y").select(GROUP, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), conflicts
