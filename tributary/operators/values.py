"""Which values are the same: copies, identities, types, reusable expressions, conflict-free groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tributary.fixpoint import GROUP, edge_table, jump, propagate
from tributary.operators.dataflow import unsafe_between
from tributary.operators.dominance import common_dominator, tree_of
from tributary.operators.domtree import dominator_tree
from tributary.operators.graph import components, flipped
from tributary.tables import cut, keep


def propagate_copies(copies: DataFrame) -> DataFrame:
    """(func_id, var, origin, steps) for ``copies(func_id, dst, src)`` of single-definition variables: the value at the chain's end."""
    ends = jump(copies.select(GROUP, F.col("dst").alias("node"), F.col("src").alias("parent")))
    return ends.select(GROUP, F.col("node").alias("var"), F.col("parent").alias("origin"), "steps")


def used_once(uses: DataFrame) -> DataFrame:
    """(func_id, var) with one using row and one occurrence in it; ``uses(func_id, block, idx, var, n)``."""
    seen = uses.groupBy(GROUP, "var").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("times"))
    return seen.filter("rows = 1 AND times = 1").select(GROUP, "var")


def propagate_through_memory(edges: DataFrame, links: DataFrame, danger: DataFrame) -> DataFrame:
    """(func_id, idx, origin, steps): how far a row's value can be traced back, in row numbers.

    ``links(func_id, idx, block, def_idx, def_block, fragile)`` leads from a using row to a definition that may be propagated at all;
    a fragile one (an aliased variable) only if no danger row lies between.
    """
    links = keep(links)
    pairs = links.filter("fragile").select(
        GROUP, F.col("idx").alias("pair"), "def_block", "def_idx", F.col("block").alias("use_block"), F.col("idx").alias("use_idx")
    )
    unsafe = unsafe_between(edges, pairs, danger).select(GROUP, F.col("pair").alias("idx"))
    safe = links.join(unsafe, [GROUP, "idx"], "left_anti")
    ends = jump(safe.select(GROUP, F.col("idx").alias("node"), F.col("def_idx").alias("parent")))
    return ends.select(GROUP, F.col("node").alias("idx"), F.col("parent").alias("origin"), "steps")


LEAF = "<leaf>"


def identity_groups(edges: DataFrame, phis: DataFrame, defined: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """(func_id, node, grp, representative): variables that hold the same value.

    ``edges(func_id, src, dst)`` lead from a variable to what it is copied or merged from; ``phis(func_id, node)`` are the merge rows;
    ``defined(func_id, node)`` the leaves that are definitions (constants, parameters, other results). A merge row that gets at two
    different leaves by ways without a common inner node is no identity: its edges are cut and it becomes a leaf. That holds exactly
    if nothing but the virtual leaf post-dominates it. Repeated until no further row is cut; a second pass with
    ``conflicts(func_id, a, b)`` also counts undefined leaves in components that hold a conflicting pair.
    """
    edges = edge_table(edges)
    dealt = edges._dealt
    phis, defined = keep(phis.select(GROUP, "node").distinct(), dealt), keep(defined.select(GROUP, "node").distinct(), dealt)
    cutoff = keep(defined.limit(0), dealt)
    for late in (False, True):
        if late and conflicts is None:
            break
        while True:
            left = edge_table(edges.join(cutoff.withColumnRenamed("node", "src"), [GROUP, "src"], "left_anti"), edges)
            nodes = edges.select(GROUP, F.explode(F.array("src", "dst")).alias("node")).distinct()
            leaves = nodes.join(left.select(GROUP, F.col("src").alias("node")).distinct(), [GROUP, "node"], "left_anti")
            counted = leaves.join(defined, [GROUP, "node"], "left_semi").unionByName(cutoff)
            if late:
                named = keep(components(left))
                a = conflicts.select(GROUP, F.col("a").alias("node"), "b").join(named, [GROUP, "node"]).drop("node")
                clash = a.join(named.withColumnRenamed("node", "b"), [GROUP, "b", "component"]).select(GROUP, "component").distinct()
                counted = counted.unionByName(leaves.join(named.join(clash, [GROUP, "component"], "left_semi"), [GROUP, "node"], "left_semi").select(GROUP, "node"))
            counted = counted.distinct()
            back = flipped(left).unionByName(counted.select(GROUP, F.lit(LEAF).alias("src"), F.col("node").alias("dst")))
            tree = dominator_tree(edge_table(back, edges), counted.select(GROUP, F.lit(LEAF).alias("root")).distinct())
            several = left.groupBy(GROUP, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            split = tree.nodes.filter(F.col("parent") == LEAF).join(phis, [GROUP, "node"], "left_semi").join(several, [GROUP, "node"], "left_semi")
            new, n, _ = cut(split.select(GROUP, "node").join(cutoff, [GROUP, "node"], "left_anti"), dealt=dealt)
            if not n:
                break
            cutoff = keep(cutoff.unionByName(new), dealt)
    left = edges.join(cutoff.withColumnRenamed("node", "src"), [GROUP, "src"], "left_anti")
    named = keep(components(left))
    ends = named.join(left.select(GROUP, F.col("src").alias("node")).distinct(), [GROUP, "node"], "left_anti")
    known = defined.unionByName(cutoff).distinct().withColumn("known", F.lit(True))
    ends = ends.join(known, [GROUP, "node"], "left").groupBy(GROUP, "component").agg(
        F.count_if(F.col("known")).alias("n"),
        F.min(F.when(F.col("known"), F.col("node"))).alias("made"),
        F.min(F.when(F.col("known").isNull(), F.col("node"))).alias("open"),
    )
    chosen = F.when(F.col("n") == 1, F.col("made")).when(F.col("n") == 0, F.col("open"))
    return named.join(ends, [GROUP, "component"], "left").select(GROUP, "node", F.col("component").alias("grp"), chosen.alias("representative"))


def fold_groups(copies: DataFrame, kinds: DataFrame) -> DataFrame:
    """(func_id, node, identity): members of copy groups and what replaces them.

    ``copies(func_id, src, dst)`` without merge rows; ``kinds(func_id, node, kind)`` with kind operation, parameter or constant, in that
    order of preference; a group without any keeps its last name.
    """
    named = keep(components(copies))
    rank = F.when(F.col("kind") == "operation", 0).when(F.col("kind") == "parameter", 1).when(F.col("kind") == "constant", 2).otherwise(3)
    ranked = named.join(kinds, [GROUP, "node"], "left").withColumn("rank", rank)
    # among equals the smallest name, without any of the three the largest
    best = ranked.groupBy(GROUP, "component").agg(
        F.min(F.struct("rank", "node")).alias("first"), F.max("node").alias("last")
    )
    identity = F.when(F.col("first.rank") < 3, F.col("first.node")).otherwise(F.col("last"))
    return named.join(best, [GROUP, "component"]).select(GROUP, "node", identity.alias("identity"))


def majority_type(values: DataFrame, keys: Sequence[str], primitive: Column, unknown: str = "Unknown") -> DataFrame:
    """(*keys, type): the value of a group. Unknown ones do not count, and any non-primitive value beats all primitive ones; among
    equals of this kind the more frequent, then the larger name. Unknown where nothing is left."""
    counted = values.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))
    vote = F.when(F.col("type") != unknown, F.struct((~primitive).alias("solid"), F.col("n"), F.col("type")))
    best = counted.groupBy(*keys).agg(F.max(vote).getField("type").alias("type"))
    return best.select(*keys, F.coalesce("type", F.lit(unknown)).alias("type"))


def type_groups(edges: DataFrame, types: DataFrame, primitive: Column, unknown: str = "Unknown") -> DataFrame:
    """(func_id, node, grp, type): variables tied by assignments share one type; ``types(func_id, node, type)`` per occurrence."""
    named = keep(components(edges))
    votes = types.join(named, [GROUP, "node"]).select(GROUP, F.col("component").alias("grp"), "type")
    chosen = majority_type(votes, [GROUP, "grp"], primitive, unknown)
    return named.withColumnRenamed("component", "grp").join(chosen, [GROUP, "grp"], "left").select(GROUP, "node", "grp", F.coalesce("type", F.lit(unknown)).alias("type"))


def placement(dom: DataFrame, uses: DataFrame) -> DataFrame:
    """(func_id, grp, block): nearest block before all uses that holds no merge use itself; ``uses(func_id, grp, node, in_phi)``."""
    blocks = keep(uses.groupBy(GROUP, "grp", "node").agg(F.bool_or("in_phi").alias("in_phi")))
    shared = keep(common_dominator(dom, blocks.select(GROUP, "grp", "node")))
    # from there up the tree, past blocks with a merge use
    steps = blocks.filter("in_phi").join(tree_of(dom).nodes, [GROUP, "node"])
    steps = jump(steps.select(GROUP, F.struct("grp", "node").alias("node"), F.struct("grp", F.col("parent").alias("node")).alias("parent")))
    past = steps.select(GROUP, "node.grp", F.col("node.node").alias("dom"), F.col("parent.node").alias("past"), F.lit(True).alias("held"))
    out = shared.join(past, [GROUP, "grp", "dom"], "left")
    return out.select(GROUP, "grp", F.when(F.col("held"), F.col("past")).otherwise(F.col("dom")).alias("block")).filter("block IS NOT NULL")


def reuse_pairs(edges: DataFrame, dom: DataFrame, rows: DataFrame, danger: DataFrame) -> DataFrame:
    """(func_id, idx, def_idx): rows whose expression an earlier row, on every way before, has computed.

    ``rows(func_id, block, idx, fp, usable, aliased)``: ``usable`` rows may serve as the earlier one. The first such row on the way from
    the root counts; if aliased, no danger row may lie between. Candidates are one row per block and expression; the one nearest to the root is
    found along the dominator tree, so a frequent expression does not pair its rows.
    """
    rows = keep(rows)
    first = rows.filter("usable").groupBy(GROUP, "block", "fp").agg(F.min(F.struct("idx", "aliased")).alias("d"))
    first = first.select(GROUP, F.col("block").alias("def_block"), "fp", F.col("d.idx").alias("def_idx"), F.col("d.aliased").alias("fragile"))
    first = keep(first)
    asked = rows.select(GROUP, F.col("block").alias("node"), "fp").distinct()
    near, above = tree_of(dom).nearest(asked, first.select(GROUP, F.col("def_block").alias("node"), "fp"), ["fp"])
    top = jump(above.select(GROUP, F.struct("fp", "node").alias("node"), F.struct("fp", F.coalesce("above", "node").alias("node")).alias("parent")), tree_of(dom).dealt)
    top = top.select(GROUP, "node.fp", F.col("node.node").alias("at"), F.col("parent.node").alias("def_block"))
    near = near.join(top, [GROUP, "fp", "at"]).select(GROUP, "fp", F.col("node").alias("block"), "def_block")
    met = rows.join(near, [GROUP, "fp", "block"]).join(first, [GROUP, "def_block", "fp"]).filter("def_block <> block OR def_idx < idx")
    best = keep(met.select(GROUP, "block", "idx", "def_idx", "def_block", "fragile"))
    pairs = best.filter("fragile").select(
        GROUP, F.col("idx").alias("pair"), "def_block", "def_idx", F.col("block").alias("use_block"), F.col("idx").alias("use_idx")
    )
    edges = edge_table(edges)
    crossed = unsafe_between(edges, pairs, danger).select(GROUP, F.col("pair").alias("idx"))
    return best.join(crossed, [GROUP, "idx"], "left_anti").select(GROUP, "idx", "def_idx")


def dead_components(edges: DataFrame, sinks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of an expression graph (instruction to value, variable to its definition, expression to part) that no sink needs."""
    live = propagate(sinks, edge_table(edges))
    return nodes.join(live, [GROUP, "node"], "left_anti")


def color_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(func_id, node, color): first-fit colouring of ``nodes(func_id, node, cls)`` with conflicts ``pairs(func_id, a, b)``.

    Only nodes of one class share a colour. The order is fixed: more conflicts first, then by name. A round colours every node that
    comes before all its uncoloured neighbours, which gives what one node at a time would.
    """
    nodes = keep(nodes)
    both = pairs.select(GROUP, "a", "b").unionByName(pairs.select(GROUP, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    cls = nodes.select(GROUP, F.col("node").alias("a"), F.col("cls").alias("ca"))
    both = both.join(cls, [GROUP, "a"]).join(cls.toDF(GROUP, "b", "cb"), [GROUP, "b"]).filter("a <> b AND ca <=> cb").select(GROUP, "a", "b")
    both = keep(both)
    degree = keep(both.groupBy(GROUP, F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    free = nodes.join(degree, [GROUP, "node"], "left_anti").select(GROUP, "node", F.lit(0).cast("bigint").alias("color"))
    # every conflict points from the earlier to the later node
    da, db = degree.toDF(GROUP, "a", "na"), degree.toDF(GROUP, "b", "nb")
    order = both.join(da, [GROUP, "a"]).join(db, [GROUP, "b"]).filter("na > nb OR (na = nb AND a < b)").select(GROUP, "a", "b")
    waiting, n, _ = cut(order.groupBy(GROUP, F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("need")))
    order = keep(order)
    start = degree.join(waiting, [GROUP, "node"], "left_anti").select(GROUP, "node", F.lit(0).cast("bigint").alias("color"))
    colored, n, _ = cut(start)
    recent = colored
    while n:
        told = recent.select(GROUP, F.col("node").alias("a")).join(order, [GROUP, "a"]).groupBy(GROUP, F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("have"))
        waiting = keep(waiting.join(told, [GROUP, "node"], "left").select(GROUP, "node", (F.col("need") - F.coalesce("have", F.lit(0))).alias("need")))
        ready = waiting.filter("need = 0").select(GROUP, "node")
        waiting = waiting.filter("need > 0")
        taken = ready.join(order.select(GROUP, "a", F.col("b").alias("node")), [GROUP, "node"]).join(colored.toDF(GROUP, "a", "color"), [GROUP, "a"])
        taken = keep(taken.select(GROUP, "node", "color").distinct())
        tries = taken.select(GROUP, "node", (F.col("color") + 1).alias("color")).unionByName(ready.withColumn("color", F.lit(0).cast("bigint")))
        smallest = tries.join(taken, [GROUP, "node", "color"], "left_anti").groupBy(GROUP, "node").agg(F.min("color").alias("color"))
        recent, n, _ = cut(smallest)
        colored = keep(colored.unionByName(recent))
    return colored.unionByName(free)


def merge_by_score(scores: DataFrame, conflicts: DataFrame, names: DataFrame) -> DataFrame:
    """(func_id, node, grp): groups grown by merging pairs that prefer each other, as long as a positive score and no conflict allow.

    ``scores(func_id, a, b, score)``, ``conflicts(func_id, a, b)``, ``names(func_id, node)``. All pairs that are each other's best
    partner merge in one round (ties by name); the scores of parallel pairs add up.
    """
    groups = keep(names.select(GROUP, "node", F.col("node").alias("grp")))

    def between(pairs: DataFrame, *more: str) -> DataFrame:
        x, y = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
        out = pairs.join(groups.toDF(GROUP, "a", "x"), [GROUP, "a"]).join(groups.toDF(GROUP, "b", "y"), [GROUP, "b"])
        return out.filter("x <> y").select(GROUP, x, y, *more)

    while True:
        open_pairs = between(scores, "score").groupBy(GROUP, "a", "b").agg(F.sum("score").alias("score")).filter("score > 0")
        open_pairs = keep(open_pairs.join(between(conflicts).distinct(), [GROUP, "a", "b"], "left_anti"))
        ends = open_pairs.select(GROUP, F.col("a").alias("x"), F.col("b").alias("y"), "score").unionByName(
            open_pairs.select(GROUP, F.col("b").alias("x"), F.col("a").alias("y"), "score")
        )
        # one order for all pairs, so that the best pair of all is always mutual
        order = F.struct("score", F.least("x", "y").alias("l"), F.greatest("x", "y").alias("h"))
        best = keep(ends.groupBy(GROUP, "x").agg(F.max_by("y", order).alias("y")))
        mutual = best.join(best.select(GROUP, F.col("y").alias("x"), F.col("x").alias("y")), [GROUP, "x", "y"], "left_semi").filter("x < y")
        mutual, n, _ = cut(mutual)
        if not n:
            return groups
        into = mutual.select(GROUP, F.col("y").alias("grp"), F.col("x").alias("target"))
        groups = keep(groups.join(into, [GROUP, "grp"], "left").select(GROUP, "node", F.coalesce("target", "grp").alias("grp")))
