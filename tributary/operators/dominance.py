"""Dominators, and the loops and regions that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.fixpoint import GROUP, edge_table, propagate
from tributary.operators.cycles import strong_components
from tributary.operators.domtree import Forest, dominator_tree
from tributary.operators.graph import flipped
from tributary.tables import cut, keep


def dominators(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(func_id, node, dom, pos): every dominator of every node that its root reaches, nodes dominating themselves included.

    ``pos`` counts dominators from the root, so the immediate dominator is the last one before the node. The relation is expanded from the dominator
    tree where its rows are read; what follows from the tree alone (``tree_of``) does not make them.
    """
    tree = dominator_tree(edges, roots)
    dom = tree.relation()
    dom._tree = tree
    return dom


def tree_of(dom: DataFrame) -> Forest:
    """The tree behind a table of dominators, rebuilt where the table comes from elsewhere."""
    tree = getattr(dom, "_tree", None)
    if tree is None:
        above = dom.filter("node <> dom").groupBy(GROUP, "node").agg(F.max_by("dom", "pos").alias("parent"))
        tree = Forest(dom.filter("node = dom").select(GROUP, "node").join(above, [GROUP, "node"], "left"))
    return tree


def immediate(dom: DataFrame) -> DataFrame:
    """(func_id, node, idom): the dominator tree."""
    return tree_of(dom).nodes.filter("parent IS NOT NULL").select(GROUP, "node", F.col("parent").alias("idom"))


def depth_in_tree(dom: DataFrame) -> DataFrame:
    """(func_id, node, depth) in the dominator tree, the root at 1."""
    return tree_of(dom).nodes.select(GROUP, "node", "depth")


def common_dominator(dom: DataFrame, groups: DataFrame) -> DataFrame:
    """(func_id, grp, dom): the nearest node dominating all nodes of ``groups(func_id, grp, node)``."""
    tree = tree_of(dom)
    groups = keep(groups.select(GROUP, "grp", "node").distinct())
    lost = groups.join(tree.nodes, [GROUP, "node"], "left_anti").select(GROUP, "grp").distinct()
    found = tree.common(groups.join(lost, [GROUP, "grp"], "left_anti"), [GROUP, "grp"], "node")
    return found.filter("meet IS NOT NULL").select(GROUP, "grp", F.col("meet").alias("dom"))


def dom_children(dom: DataFrame) -> DataFrame:
    """(func_id, node, child): direct children in the dominator tree."""
    return immediate(dom).select(GROUP, F.col("idom").alias("node"), F.col("node").alias("child"))


def dom_sizes(dom: DataFrame) -> DataFrame:
    """(func_id, head, n_nodes): how many nodes a head dominates, itself included."""
    return tree_of(dom).places().select(GROUP, F.col("node").alias("head"), ((F.col("leave") - F.col("place") + 1) / 2).cast("bigint").alias("n_nodes"))


def dom_region(dom: DataFrame) -> DataFrame:
    """(func_id, head, node): all nodes a head dominates, itself included."""
    return dom.select(GROUP, F.col("dom").alias("head"), "node")


def edge_classes(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(func_id, src, dst, edge_class) of the edges reachable from the root, whatever the order of a visit.

    ``back``: the sink dominates the source; ``irreducible``: still on a cycle without the back edges; else ``acyclic``.
    """
    tree = tree_of(dom)
    seen = tree.nodes.select(GROUP, F.col("node").alias("src"))
    edges = edge_table(edges.join(seen, [GROUP, "src"], "left_semi"), tree.nodes)
    dealt = edges._dealt
    back = tree.above(edges, "dst", "src")
    back = back if tree.dealt else keep(back, dealt)
    ring = strong_components(edges.join(back, [GROUP, "src", "dst"], "left_anti"), dealt)
    # without the back edges an edge is on a cycle if both ends are in one component
    inside = edges.join(ring.select(GROUP, F.col("node").alias("src"), F.col("component").alias("a")), [GROUP, "src"])
    inside = inside.join(ring.select(GROUP, F.col("node").alias("dst"), F.col("component").alias("b")), [GROUP, "dst"]).filter("a = b").select(GROUP, "src", "dst")
    marks = back.withColumn("kind", F.lit(0)).unionByName(inside.withColumn("kind", F.lit(1))).groupBy(GROUP, "src", "dst").agg(F.min("kind").alias("kind"))
    named = F.when(F.col("kind") == 0, "back").when(F.col("kind") == 1, "irreducible").otherwise("acyclic")
    return keep(edges.join(marks, [GROUP, "src", "dst"], "left").select(GROUP, "src", "dst", named.alias("edge_class")), dealt)


def loop_edges(classes: DataFrame) -> DataFrame:
    """(func_id, head, n_edges, kind): loop entries; one retreating (irreducible) edge makes the entry retreating."""
    loops = classes.filter("edge_class <> 'acyclic'").groupBy(GROUP, F.col("dst").alias("head"))
    kind = F.when(F.bool_or(F.col("edge_class") == "irreducible"), "retreating").otherwise("back")
    return loops.agg(F.count(F.lit(1)).alias("n_edges"), kind.alias("kind"))


def loop_bodies(classes: DataFrame) -> DataFrame:
    """(func_id, head, node): per head the nodes on ways from it to its latching nodes that use no loop edge."""
    dealt = getattr(classes, "_dealt", 0)
    loops = keep(classes.filter("edge_class <> 'acyclic'"), dealt)
    plain = edge_table(classes.filter("edge_class = 'acyclic'"), classes)
    heads = loops.select(GROUP, F.col("dst").alias("node"), F.col("dst").alias("head")).distinct()
    latches = loops.select(GROUP, F.col("src").alias("node"), F.col("dst").alias("head"))
    ahead = propagate(heads, plain, tags=["head"])
    behind = propagate(latches, edge_table(flipped(plain), plain), tags=["head"], within=ahead)
    return keep(behind.unionByName(heads).distinct().select(GROUP, "head", "node"), dealt)


def region_successors(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(func_id, head, node): nodes outside a region next to one inside."""
    after = regions.withColumnRenamed("node", "src").join(edges, [GROUP, "src"]).select(GROUP, "head", F.col("dst").alias("node"))
    return after.distinct().join(regions, [GROUP, "head", "node"], "left_anti")


def region_sinks(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(func_id, head, node): region nodes without successor, or with one outside the region."""
    inside = regions.select(GROUP, "head", F.col("node").alias("dst"), F.lit(True).alias("inside"))
    after = regions.join(edges.withColumnRenamed("src", "node"), [GROUP, "node"], "left").join(inside, [GROUP, "head", "dst"], "left")
    return _stored(after.filter("inside IS NULL").select(GROUP, "head", "node").distinct(), regions)


def _stored(rows: DataFrame, like: DataFrame) -> DataFrame:
    """What follows from a dealt table, stored where its joins need no shuffle; else as it is."""
    dealt = getattr(like, "_dealt", 0)
    return keep(rows, dealt) if dealt else rows


def loop_exits(edges: DataFrame, bodies: DataFrame, roots: DataFrame) -> DataFrame:
    """(func_id, head, node): loop successors after refinement.

    While a loop has several successors, those whose predecessors all lie inside are taken into the region, all of a round at once.
    """
    edges = edge_table(edges)
    dealt = edges._dealt
    region, after, roots = keep(bodies, dealt), keep(region_successors(edges, bodies), dealt), keep(roots, dealt)
    while True:
        several = after.groupBy(GROUP, "head").count().filter("count > 1").select(GROUP, "head")
        asked = after.join(several, [GROUP, "head"], "left_semi").join(roots.select(GROUP, F.col("root").alias("node")), [GROUP, "node"], "left_anti")
        before = asked.join(edges.select(GROUP, F.col("dst").alias("node"), "src"), [GROUP, "node"])
        inside = region.select(GROUP, "head", F.col("node").alias("src"), F.lit(True).alias("inside"))
        full = before.join(inside, [GROUP, "head", "src"], "left").groupBy(GROUP, "head", "node").agg(F.count_if(F.col("inside").isNull()).alias("out"))
        taken, n, _ = cut(full.filter("out = 0").select(GROUP, "head", "node"), dealt=dealt)
        if not n:
            return after
        region = keep(region.unionByName(taken), dealt)
        after = keep(region_successors(edges, region), dealt)


def irregular_loops(edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """(func_id, head, n_nodes, n_entries, n_exits): abnormal entries are nodes besides the head with an edge from outside."""
    edges = edge_table(edges)
    inside = bodies.select(GROUP, "head", F.col("node").alias("src"), F.lit(True).alias("inside"))
    before = bodies.filter("node <> head").join(edges.select(GROUP, F.col("dst").alias("node"), "src"), [GROUP, "node"])
    entries = before.join(inside, [GROUP, "head", "src"], "left").filter("inside IS NULL")
    entries = entries.groupBy(GROUP, "head").agg(F.countDistinct("node").alias("n_entries"))
    exits = region_successors(edges, bodies).groupBy(GROUP, "head").agg(F.count(F.lit(1)).alias("n_exits"))
    size = bodies.groupBy(GROUP, "head").agg(F.count(F.lit(1)).alias("n_nodes"))
    out = size.join(entries, [GROUP, "head"], "left").join(exits, [GROUP, "head"], "left").na.fill(0, ["n_entries", "n_exits"])
    return _stored(out, bodies)


def regions(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(func_id, head, n_nodes): dominance regions that can be replaced by one node.

    Large enough (three nodes, or two in a graph of two), and left from at most one node, or, towards a single successor, so that all
    ways from the head to it are exactly the region.
    """
    edges = edge_table(edges)
    dealt = edges._dealt
    region = keep(dom_region(dom), dealt)
    # every node's region is made here anyway; counting it takes no walk around the tree
    size = region.groupBy(GROUP, "head").agg(F.count(F.lit(1)).alias("n_nodes"))
    graph = tree_of(dom).nodes.groupBy(GROUP).agg(F.count(F.lit(1)).alias("total"))
    size = size.join(graph, GROUP).filter("(total >= 3 AND n_nodes >= 3) OR (total = 2 AND n_nodes = 2)").drop("total")
    inside = region.select(GROUP, "head", F.col("node").alias("dst"), F.lit(True).alias("inside"))
    out = region.join(edges.withColumnRenamed("src", "node"), [GROUP, "node"]).join(inside, [GROUP, "head", "dst"], "left").filter("inside IS NULL")
    out = keep(out.select(GROUP, "head", "node", "dst").distinct(), dealt)
    left = out.groupBy(GROUP, "head").agg(F.countDistinct("node").alias("exits"), F.countDistinct("dst").alias("targets"), F.min("dst").alias("succ"))
    left = keep(size.join(left, [GROUP, "head"], "left").na.fill(0, ["exits", "targets"]), dealt)
    simple = left.filter("exits <= 1 OR targets = 0")
    # several exit nodes but one successor: compare the slice head..successor with the region
    ask = keep(left.filter("exits > 1 AND targets = 1").select(GROUP, "head", "succ", "n_nodes"), dealt)
    ahead = propagate(ask.select(GROUP, F.col("head").alias("node"), "head"), edges, tags=["head"])
    behind = propagate(ask.select(GROUP, F.col("succ").alias("node"), "head"), edge_table(flipped(edges), edges), tags=["head"], within=ahead)
    sliced = behind.join(ask, [GROUP, "head"]).join(region.withColumn("inside", F.lit(1)), [GROUP, "head", "node"], "left")
    sliced = sliced.groupBy(GROUP, "head", "n_nodes").agg(
        F.count("inside").alias("common"), F.count_if(F.col("inside").isNull() & (F.col("node") != F.col("succ"))).alias("other")
    )
    exact = sliced.filter("common = n_nodes AND other = 0")
    return _stored(simple.select(GROUP, "head", "n_nodes").unionByName(exact.select(GROUP, "head", "n_nodes")), edges)


def noreturn_boundary(edges: DataFrame, nodes: DataFrame, noreturn: DataFrame) -> DataFrame:
    """(func_id, src, dst): edges after which a way can only end in a leaf that does not return.

    All such leaves hang on one virtual node under a virtual end; the edges lead from its post-dominance frontier into nodes that it
    post-dominates. These are the nodes with a way to the end, but none around the virtual node: one search back from the other leaves and one from
    its own, as no tree is needed to ask about a single dominator. Graphs of a single node stay out.
    """
    edges = edge_table(edges)
    dealt = edges._dealt
    several = nodes.groupBy(GROUP).count().filter("count > 1").select(GROUP)
    leaves = nodes.join(several, GROUP, "left_semi").join(edges.select(GROUP, F.col("src").alias("node")).distinct(), [GROUP, "node"], "left_anti")
    leaves = keep(leaves.join(noreturn.select(GROUP, "node", F.lit(True).alias("lost")).distinct(), [GROUP, "node"], "left"), dealt)
    back = edge_table(flipped(edges), edges)
    around = propagate(leaves.filter("lost IS NULL"), back)
    # whoever has a way into ``around`` is in it, so ways to the virtual node never lead through it
    doomed = propagate(leaves.filter("lost"), back, never=around)
    into = edges.join(doomed.withColumnRenamed("node", "dst"), [GROUP, "dst"], "left_semi")
    # a doomed successor but not doomed itself: such a node is the frontier
    out = into.join(doomed.withColumnRenamed("node", "src"), [GROUP, "src"], "left_anti")
    return _stored(out, edges)
