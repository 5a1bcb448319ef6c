"""Row kinds as column predicates, and filters that need a look at neighbouring rows.

Instruction rows carry ``kind`` (assignment, call, branch, indirect branch, relation, return, phi, …) and, for assignments, ``dest``: what
is written (variable, dereference, list, unknown) — null counting as a variable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tributary.fixpoint import GROUP, edge_table, jump, propagate
from tributary.tables import keep

ASSIGNING = ("assignment", "call", "phi")


def is_sink(relation_is_sink: bool = True) -> Column:
    """Rows that matter by themselves: all but assignments, call assignments, and stores through a dereference."""
    plain = F.col("kind").isin("assignment", "phi") & (F.coalesce(F.col("dest"), F.lit("variable")) != "dereference")
    return ~plain if relation_is_sink else ~plain & (F.col("kind") != "relation")


def is_definition() -> Column:
    """Assignments to a variable: neither a store through a dereference nor a call without result (an empty list)."""
    return F.col("kind").isin(*ASSIGNING) & ~F.coalesce(F.col("dest"), F.lit("variable")).isin("dereference", "empty list")


def is_copy() -> Column:
    """variable = variable."""
    return (F.col("kind") == "assignment") & (F.col("form") == "copy") & (F.coalesce(F.col("dest"), F.lit("variable")) == "variable")


def can_propagate(into_phi: Column, into_address: Column) -> Column:
    """Definitions whose value may replace their variable in a using row.

    Columns ``kind``, ``form`` (copy, operation, constant, address, dereference), ``dest``, ``aliased``, ``writeable_global``; the two
    arguments tell whether the using row is a merge row, or would take the address of the value.
    """
    return (
        (F.col("kind") == "assignment")
        & (F.coalesce(F.col("dest"), F.lit("variable")) == "variable")
        & ~F.col("form").isin("address", "dereference")
        & ~F.col("aliased")
        & ~F.col("writeable_global")
        & ~((F.col("form") == "operation") & into_phi)
        & ~((F.col("form") != "copy") & into_address)
    )


def block_types(instr: DataFrame) -> DataFrame:
    """(func_id, block, ctl_type) from the last row of a block: direct, conditional or indirect."""
    last = instr.groupBy(GROUP, "block").agg(F.max_by("kind", "idx").alias("kind"))
    kind = F.when(F.col("kind") == "branch", "conditional").when(F.col("kind") == "indirect branch", "indirect").otherwise("direct")
    return last.select(GROUP, "block", kind.alias("ctl_type"))


def edge_conditions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(func_id, node, is_conditional, is_switch): whether all out-edges are true/false, or switch edges; both hold without out-edges."""
    outs = edges.groupBy(GROUP, F.col("src").alias("node")).agg(
        F.bool_and(F.col("kind").isin("true", "false")).alias("c"), F.bool_and(F.col("kind") == "switch").alias("s")
    )
    out = nodes.join(outs, [GROUP, "node"], "left")
    return out.select(GROUP, "node", F.coalesce("c", F.lit(True)).alias("is_conditional"), F.coalesce("s", F.lit(True)).alias("is_switch"))


def noreturn_leaves(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """Leaves with exactly one call whose callee cannot return; ``calls(func_id, node, can_return)``."""
    leaves = nodes.join(edges.select(GROUP, F.col("src").alias("node")), [GROUP, "node"], "left_anti")
    one = calls.groupBy(GROUP, "node").agg(F.count(F.lit(1)).alias("n"), F.bool_or("can_return").alias("back")).filter("n = 1 AND NOT back")
    return leaves.join(one, [GROUP, "node"], "left_semi")


def guard_leaves(nodes: DataFrame, edges: DataFrame, texts: DataFrame, marker: str, guarded: DataFrame) -> DataFrame:
    """Leaves holding a text with ``marker``, or entered by the failing side of a guard.

    ``texts(func_id, node, text)``; ``guarded(func_id, src, op, operand_fits)`` describes the comparison that ends a block: leaving it by
    equal/false or not_equal/true with a fitting operand is a failure.
    """
    leaves = keep(nodes.join(edges.select(GROUP, F.col("src").alias("node")), [GROUP, "node"], "left_anti"))
    marked = texts.filter(F.col("text").contains(marker)).select(GROUP, "node")
    fails = ((F.col("op") == "equal") & (F.col("kind") == "false")) | ((F.col("op") == "not_equal") & (F.col("kind") == "true"))
    entered = edges.join(guarded.filter("operand_fits"), [GROUP, "src"]).filter(fails).select(GROUP, F.col("dst").alias("node"))
    return leaves.join(marked.unionByName(entered).distinct(), [GROUP, "node"], "left_semi")


FLOORS: Mapping[str, int] = {"assignment": 2, "call": 1, "return": 2}


def over_complexity(instr: DataFrame, bounds: Mapping[str, int]) -> DataFrame:
    """Rows more complex than the bound of their kind; bounds below the floor of the kind are raised to it."""
    limit = F.lit(None).cast("int")
    for kind, low in FLOORS.items():
        limit = F.when(F.col("kind") == kind, F.lit(max(bounds.get(kind, low), low))).otherwise(limit)
    return instr.filter(F.col("complexity") > limit)


def contract_empty(edges: DataFrame, empty: DataFrame) -> DataFrame:
    """(func_id, src, dst, kind, cases, n): the graph without its empty blocks.

    ``edges(func_id, src, dst, kind, cases)``, ``empty(func_id, node)``. An empty block with one successor passes its predecessors on to
    it; chains are followed to their end. Parallel edges merge: switch cases add up, different ends of a branch become unconditional.
    Empty blocks that lead only to each other in a circle, or that have several or no successors, stay.
    """
    edges = keep(edges)
    outs = edges.groupBy(GROUP, F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n"), F.min("dst").alias("parent"))
    hops = keep(outs.filter("n = 1").join(empty, [GROUP, "node"], "left_semi").select(GROUP, "node", "parent").filter("node <> parent"))
    # a circle of empty blocks has no end: follow only hops from which a block that stays can be reached
    back = hops.select(GROUP, F.col("parent").alias("src"), F.col("node").alias("dst"))
    ends = hops.select(GROUP, F.col("parent").alias("node")).distinct().join(hops.select(GROUP, "node"), [GROUP, "node"], "left_anti")
    fine = propagate(ends, edge_table(back))
    hops = hops.join(fine, [GROUP, "node"], "left_semi")
    target = keep(jump(hops).select(GROUP, F.col("node").alias("dst"), F.col("parent").alias("end")))
    left = edges.join(target.select(GROUP, F.col("dst").alias("src")), [GROUP, "src"], "left_anti").join(target, [GROUP, "dst"], "left")
    left = left.select(GROUP, "src", F.coalesce("end", "dst").alias("dst"), "kind", "cases")
    cases = left.withColumn("case", F.explode_outer("cases")).groupBy(GROUP, "src", "dst").agg(F.sort_array(F.collect_set("case")).alias("cases"))
    kinds = left.groupBy(GROUP, "src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high")
    )
    kind = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("unconditional")
    return kinds.join(cases, [GROUP, "src", "dst"]).select(GROUP, "src", "dst", kind.alias("kind"), "cases", "n")


def contains_any(column: str, markers: Sequence[str]) -> Column:
    """Whether the text holds one of the markers."""
    out = F.lit(False)
    for m in markers:
        out = out | F.col(column).contains(m)
    return out
