"""Versioned values: merge rows, memory versions, pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tributary.fixpoint import GROUP, edge_table, propagate
from tributary.operators.cycles import strong_components
from tributary.operators.dominance import tree_of
from tributary.tables import keep


#: Rows of a product that a task is to make; a function with more is spread over several.
PRODUCT = 1_000_000


def product(left: DataFrame, right: DataFrame, per_task: int = PRODUCT) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` of its function.

    Where a function's product is large its left rows are dealt out over as many salts as that takes, and its right rows are repeated for each of them.
    """
    a, b = (df.groupBy(GROUP).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_a"), (right, "_b")))
    salts = F.least(F.ceil(F.col("_a") * F.col("_b") / per_task), F.col("_a")).cast("int")
    sizes = keep(a.join(b, GROUP).select(GROUP, salts.alias("_salts")))
    dealt = left.join(sizes, GROUP).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), "_salts").cast("int")).drop("_salts")
    repeated = right.join(sizes, GROUP).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return dealt.join(repeated, [GROUP, "_salt"]).drop("_salt")


def expand_mem_phi(phis: DataFrame, aliased: DataFrame) -> DataFrame:
    """One merge argument per aliased variable: ``phis(func_id, block, idx, pred_block, ver)`` x ``aliased(func_id, name)``.

    All memory merge rows of a block are expanded. Functions without aliased variables lose theirs.
    """
    out = product(phis, aliased)
    return out.select(GROUP, "block", "name", F.concat_ws("#", "name", "idx").alias("var"), "pred_block", F.concat_ws("#", "name", "ver").alias("arg"))


def missing_versions(aliased: DataFrame, memory: DataFrame, existing: DataFrame) -> DataFrame:
    """(func_id, name, version): memory versions at which an aliased variable has no definition of its own.

    Every variable of a function meets every version of it, because each such pair without a definition is a result.
    """
    wanted = product(memory.select(GROUP, "version").distinct(), aliased.select(GROUP, "name")).select(GROUP, "name", "version")
    return wanted.join(existing, [GROUP, "name", "version"], "left_anti")


def nearest_dominating(points: DataFrame, known: DataFrame, dom: DataFrame) -> DataFrame:
    """(func_id, block, name, version, …): per point the highest version of the nearest block dominating it that has one."""
    best = keep(known.groupBy(GROUP, "block", "name").agg(F.max("version").alias("version")))
    asked = points.select(GROUP, F.col("block").alias("node"), "name").distinct()
    near, _ = tree_of(dom).nearest(asked, best.select(GROUP, F.col("block").alias("node"), "name"), ["name"])
    near = near.select(GROUP, F.col("node").alias("block"), "name", F.col("at").alias("def_block"))
    near = near.join(best.withColumnRenamed("block", "def_block"), [GROUP, "def_block", "name"])
    return points.distinct().join(near, [GROUP, "block", "name"]).select(*points.columns, "version")


def phi_origins(phis: DataFrame, edges: DataFrame, known: DataFrame, dom: DataFrame) -> DataFrame:
    """(func_id, block, name, pred_block, version, def_block): the value that a merge row gets over each predecessor.

    The definition of the predecessor or of the nearest block dominating it; null where none dominates: the value from outside.
    """
    args = phis.join(edges.select(GROUP, F.col("dst").alias("block"), F.col("src").alias("pred_block")).distinct(), [GROUP, "block"])
    args = keep(args)
    best = keep(known.groupBy(GROUP, F.col("block").alias("def_block"), "name").agg(F.max("version").alias("version")))
    asked = args.select(GROUP, F.col("pred_block").alias("node"), "name").distinct()
    near, _ = tree_of(dom).nearest(asked, best.select(GROUP, F.col("def_block").alias("node"), "name"), ["name"])
    near = near.select(GROUP, F.col("node").alias("pred_block"), "name", F.col("at").alias("def_block"))
    near = near.join(best, [GROUP, "def_block", "name"])
    return args.join(near, [GROUP, "pred_block", "name"], "left").select(GROUP, "block", "name", "pred_block", "version", "def_block")


def points_to(seeds: DataFrame, copies: DataFrame) -> DataFrame:
    """(func_id, ptr, target) from ``seeds(func_id, ptr, target)`` over ``copies(func_id, src, dst)``, merge arguments among them.

    The smallest solution: a pointer holds whatever any of its sources holds, loops included.
    """
    held = propagate(seeds.select(GROUP, F.col("ptr").alias("node"), "target"), edge_table(copies), tags=["target"])
    return held.withColumnRenamed("node", "ptr")


def shared_var(pairs: DataFrame, uses: DataFrame) -> DataFrame:
    """``pairs(func_id, a, b)`` with exactly one variable of ``uses(func_id, item, var)`` in common, and that variable."""
    left = pairs.join(uses.withColumnRenamed("item", "a"), [GROUP, "a"])
    both = left.join(uses.withColumnRenamed("item", "b"), [GROUP, "b", "var"], "left_semi")
    found = both.groupBy(GROUP, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("var").alias("var"))
    return found.filter("n = 1").drop("n")


def _placed(name: str) -> Column:
    """A merge row as a node: what is merged under one name in two blocks are two rows."""
    return F.struct("block", F.col(name).alias("var"))


def phi_deps(phi_args: DataFrame) -> DataFrame:
    """(func_id, block, src, dst): merge row ``src`` has the merge row ``dst`` of its block among its arguments; not itself."""
    made = phi_args.select(GROUP, "block", F.col("var").alias("arg")).distinct()
    used = phi_args.filter("var <> arg").join(made, [GROUP, "block", "arg"], "left_semi")
    return used.select(GROUP, "block", F.col("var").alias("src"), F.col("arg").alias("dst")).distinct()


def phi_cycles(phi_args: DataFrame) -> DataFrame:
    """(func_id, block, var): merge rows that depend on themselves through others of their block."""
    deps = phi_deps(phi_args).select(GROUP, _placed("src").alias("src"), _placed("dst").alias("dst"))
    return strong_components(keep(deps)).select(GROUP, "node.block", "node.var")


def trivial_phis(phi_args: DataFrame) -> DataFrame:
    """(func_id, block, var, value, action): merge rows with one distinct argument.

    ``drop`` where that is the row's own variable, else ``copy`` if the argument is not made by another merge row of the same block, or by
    one that goes. Removing one may free the next, so this repeats until nothing changes; rows that wait for each other stay.
    """
    one = phi_args.groupBy(GROUP, "block", "var").agg(F.min("arg").alias("value"), F.max("arg").alias("most"))
    one = keep(one.select(GROUP, "block", "var", "value", (F.col("value") == F.col("most")).alias("single")))
    chosen = one.filter("single").drop("single")
    made = one.select(GROUP, "block", F.col("var").alias("value"))
    outside = chosen.join(made, [GROUP, "block", "value"], "left_anti").select(chosen.columns)
    free = chosen.filter("var = value").unionByName(outside).select(GROUP, _placed("var").alias("node"))
    uses = chosen.filter("var <> value").select(GROUP, _placed("value").alias("src"), _placed("var").alias("dst"))
    gone = propagate(free, edge_table(uses)).select(GROUP, "node.block", "node.var")
    out = chosen.join(gone, [GROUP, "block", "var"])
    return out.withColumn("action", F.when(F.col("var") == F.col("value"), "drop").otherwise("copy"))
