"""What flows where: definitions, uses, liveness, interference, dead rows.

Rows are instructions: ``(func_id, block, idx, …)`` with ``idx`` unique and increasing inside a block. ``defs(func_id, block, idx, var)``
and ``uses(func_id, block, idx, var)`` list what they write and read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tributary.fixpoint import GROUP, edge_table, least, propagate
from tributary.functions.ordered import Ordered
from tributary.operators.dominance import tree_of
from tributary.operators.graph import flipped
from tributary.operators.ranges import points_in_intervals
from tributary.tables import keep


def def_use(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Every use with the row of its single definition, null where there is none."""
    found = defs.select(GROUP, "var", F.col("block").alias("def_block"), F.col("idx").alias("def_idx"))
    return uses.join(found, [GROUP, "var"], "left")


def undefined_vars(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(func_id, var): used, defined nowhere."""
    return uses.select(GROUP, "var").distinct().join(defs.select(GROUP, "var"), [GROUP, "var"], "left_anti")


def ssa_violations(defs: DataFrame) -> DataFrame:
    """(func_id, var, n): variables with several definitions."""
    return defs.groupBy(GROUP, "var").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def asof_def(defs: DataFrame, uses: DataFrame, inclusive: bool = True) -> DataFrame:
    """Uses with ``def_idx``: the last definition of the variable at (or, not inclusive, before) the use in its block."""
    key = [GROUP, "block", "var"]
    points = uses.select(*key, "idx", F.lit(1).alias("is_use"), F.lit(None).cast("bigint").alias("at"))
    known = defs.select(*key, "idx", F.lit(0).alias("is_use"), F.col("idx").alias("at"))
    # at equal positions a definition counts if inclusive, so it goes first
    turn = F.col("is_use") if inclusive else -F.col("is_use")
    rows = Ordered(points.unionByName(known).withColumn("turn", turn), key, ["idx", "turn"])
    return rows.last_known(F.col("at"), "def_idx", False).filter("is_use = 1").select(*key, "idx", "def_idx")


def row_states(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Uses with the in-block definition of their variable before and after the row itself."""
    before = asof_def(defs, uses, inclusive=False).withColumnRenamed("def_idx", "before_idx")
    after = asof_def(defs, uses).withColumnRenamed("def_idx", "after_idx")
    return before.join(after, [GROUP, "block", "var", "idx"])


def liveness(edges: DataFrame, defs: DataFrame, uses: DataFrame, phi_defs: DataFrame, phi_uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live_in, live_out) as (func_id, block, var).

    ``phi_defs(func_id, block, var)``; ``phi_uses(func_id, block, var)`` belong to the predecessor, a null block being the outside.
    A block that defines a variable does not take it in; a merge row's own variable is live in its block only if used.
    """
    back = edge_table(flipped(edges), edges)
    dealt = back._dealt
    wrote = keep(defs.select(GROUP, F.col("block").alias("node"), "var").distinct(), dealt)
    merged = keep(phi_defs.select(GROUP, F.col("block").alias("node"), "var").distinct(), dealt)
    read = uses.select(GROUP, F.col("block").alias("node"), "var").unionByName(
        phi_uses.filter("block IS NOT NULL").select(GROUP, F.col("block").alias("node"), "var")
    )
    live = propagate(read, back, tags=["var"], stop=merged, never=wrote)
    passed = live.join(merged, [GROUP, "node", "var"], "left_anti").withColumnRenamed("node", "dst")
    out = passed.join(edges.select(GROUP, "src", "dst").distinct(), [GROUP, "dst"]).select(GROUP, F.col("src").alias("block"), "var")
    return live.withColumnRenamed("node", "block"), keep(out.unionByName(phi_uses.select(GROUP, "block", "var")).distinct(), dealt)


def reaching_defs(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """(func_id, block, var, def_idx): definitions that reach the start of a block."""
    edges = edge_table(edges)
    last = keep(defs.groupBy(GROUP, "block", "var").agg(F.max("idx").alias("def_idx")), edges._dealt)
    seed = last.withColumnRenamed("block", "src").join(edges, [GROUP, "src"]).select(GROUP, F.col("dst").alias("node"), "var", "def_idx")
    kills = last.select(GROUP, F.col("block").alias("node"), "var")
    reached = propagate(seed, edges, tags=["var", "def_idx"], stop=kills)
    out = reached.withColumnRenamed("node", "block")
    out._dealt = edges._dealt
    return out


def reaching_out(edges: DataFrame, defs: DataFrame, reach_in: DataFrame) -> DataFrame:
    """(func_id, block, var, def_idx): definitions that reach the end of a block."""
    last = defs.groupBy(GROUP, "block", "var").agg(F.max("idx").alias("def_idx"))
    dealt = getattr(reach_in, "_dealt", 0)
    last = keep(last, dealt)
    through = reach_in.join(last.drop("def_idx"), [GROUP, "block", "var"], "left_anti")
    return keep(through.unionByName(last), dealt) if dealt else through.unionByName(last)


def reaching_uses(edges: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(func_id, block, var, idx, def_idx): all definitions a use may read; the nearest of the block, else those reaching the block."""
    local = keep(asof_def(defs, uses, inclusive=False))
    entering = reaching_defs(edges, defs)
    far = local.filter("def_idx IS NULL").drop("def_idx").join(entering, [GROUP, "block", "var"])
    return local.filter("def_idx IS NOT NULL").unionByName(far)


def block_summary(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(func_id, block, var, is_defined, is_dependency): per block all variables; a dependency is used and not defined there."""
    rows = defs.select(GROUP, "block", "var", F.lit(1).alias("d")).unionByName(uses.select(GROUP, "block", "var", F.lit(0).alias("d")))
    out = rows.groupBy(GROUP, "block", "var").agg(F.max("d").alias("d"))
    return out.select(GROUP, "block", "var", (F.col("d") == 1).alias("is_defined"), (F.col("d") == 0).alias("is_dependency"))


def interference(edges: DataFrame, roots: DataFrame, defs: DataFrame, uses: DataFrame, phi_defs: DataFrame, phi_uses: DataFrame) -> DataFrame:
    """(func_id, a, b), a < b: variables live at the same time, each variable having one definition.

    Two such variables meet at the definition of one of them, or are both live where a way begins. So every definition is joined with
    what is live after it, and pairs are formed otherwise only among variables live at a start (undefined ones, parameters).
    """
    edges = edge_table(edges)
    dealt = edges._dealt
    defs, uses = (keep(df.select(GROUP, "block", "var", "idx"), dealt) for df in (defs, uses))
    live_in, live_out = liveness(edges, defs, uses, phi_defs, phi_uses)
    live_in = keep(live_in, dealt)
    # a merge row acts before the block's rows (position 0), what is live at the end outlives them all
    begin = live_in.select(GROUP, "block", "var", F.lit(0).alias("lo"), F.lit(1).alias("hi"))
    merged = phi_defs.select(GROUP, "block", "var").distinct()
    begin = begin.unionByName(merged.select(GROUP, "block", "var", F.lit(0).alias("lo"), F.lit(1).alias("hi")))
    made = defs.select(GROUP, "block", "var", (F.col("idx") + 1).alias("lo"), (F.col("idx") + 1).alias("hi"))
    last = defs.select(GROUP, "block", "idx").unionByName(uses.select(GROUP, "block", "idx"))
    last = last.groupBy(GROUP, "block").agg((F.max("idx") + 2).alias("hi"))
    final = live_out.join(last, [GROUP, "block"], "left").select(
        GROUP, "block", "var", F.lit(None).cast("bigint").alias("lo"), F.coalesce("hi", F.lit(1)).alias("hi")
    )
    read = uses.select(GROUP, "block", "var", F.lit(None).cast("bigint").alias("lo"), (F.col("idx") + 1).alias("hi"))
    spans = begin.unionByName(made).unionByName(final).unionByName(read).groupBy(GROUP, "block", "var").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = keep(spans.filter("lo < hi AND block IS NOT NULL").withColumnRenamed("var", "other"), dealt)
    points = defs.select(GROUP, "block", "var", (F.col("idx") + 1).alias("at")).unionByName(merged.withColumn("at", F.lit(0)))
    met = points_in_intervals(points, spans, [GROUP, "block"], "at", "lo", "hi").select(GROUP, F.col("var").alias("x"), F.col("other").alias("y"))

    seen = propagate(roots.select(GROUP, F.col("root").alias("node")), edges).withColumnRenamed("node", "block")
    begins = live_in.join(seen, [GROUP, "block"], "left_anti").unionByName(
        live_in.join(roots.select(GROUP, F.col("root").alias("block")), [GROUP, "block"], "left_semi")
    ).unionByName(live_out.filter("block IS NULL").withColumn("block", F.lit("")))
    begins = keep(begins.distinct(), dealt)
    both = begins.withColumnRenamed("var", "x").join(begins.withColumnRenamed("var", "y"), [GROUP, "block"]).filter("x < y").select(GROUP, "x", "y")
    pairs = met.unionByName(both).filter("x <> y")
    pairs = pairs.select(GROUP, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return keep(pairs, dealt) if dealt else pairs


def dead_rows(sinks: DataFrame, results: DataFrame, depends: DataFrame) -> DataFrame:
    """(func_id, idx, status): ``dead`` rows, and rows that stay although their result is dead (``dead_result``).

    ``sinks(func_id, idx)`` stay in any case, ``results(func_id, idx)`` write something, ``depends(func_id, idx, on_idx)`` says which row
    a row needs; pointer edges may be among them.
    """
    edges = depends.select(GROUP, F.col("idx").alias("src"), F.col("on_idx").alias("dst"))
    live = keep(propagate(sinks.select(GROUP, F.col("idx").alias("node")), edge_table(edges)).withColumnRenamed("node", "idx"))
    needed = live.join(depends, [GROUP, "idx"]).select(GROUP, F.col("on_idx").alias("idx")).distinct()
    dead = results.select(GROUP, "idx").join(live, [GROUP, "idx"], "left_anti").withColumn("status", F.lit("dead"))
    idle = results.select(GROUP, "idx").join(sinks.select(GROUP, "idx"), [GROUP, "idx"], "left_semi").join(needed, [GROUP, "idx"], "left_anti")
    return dead.unionByName(idle.withColumn("status", F.lit("dead_result")))


def unsafe_between(edges: DataFrame, pairs: DataFrame, danger: DataFrame) -> DataFrame:
    """Rows of ``pairs(func_id, pair, def_block, def_idx, use_block, use_idx)`` with a ``danger(func_id, block, idx)`` row between.

    In one block the danger lies at or after the definition and before the use. Otherwise before the use in its block, after the
    definition in its block, or in a third block on a way between the two. Per block the first and last danger decide. For third blocks
    the graph is walked with what was met on the way, per definition's block and only where a way leads to one of its uses.
    """
    edges = edge_table(edges)
    dealt = edges._dealt
    pairs = keep(pairs, dealt)
    danger = keep(danger.select(GROUP, "block", "idx").distinct(), dealt)
    ends = keep(danger.groupBy(GROUP, "block").agg(F.min("idx").alias("first"), F.max("idx").alias("last")), dealt)
    same = pairs.filter("def_block = use_block")
    nxt = _next_danger(same, danger).filter("next_idx < use_idx")
    apart = keep(pairs.filter("def_block <> use_block"), dealt)
    in_use = apart.join(ends.withColumnRenamed("block", "use_block"), [GROUP, "use_block"]).filter("first < use_idx")
    in_def = apart.join(ends.withColumnRenamed("block", "def_block"), [GROUP, "def_block"]).filter("last > def_idx")
    # a third block: between the definition's block and the use's; per definition's block only nodes on ways to its own uses
    asked = keep(apart.select(GROUP, F.col("def_block").alias("start"), "use_block").distinct(), dealt)
    starts = asked.select(GROUP, F.col("start").alias("node"), "start").distinct()
    uses = asked.select(GROUP, F.col("use_block").alias("node"), "start")
    ways = propagate(uses, edge_table(flipped(edges), edges), tags=["start"], within=propagate(starts, edges, tags=["start"]))
    met = _dangers_met(edges, ways if dealt else keep(ways), ends.select(GROUP, F.col("block").alias("node")))
    hit = asked.join(met.withColumnRenamed("node", "use_block"), [GROUP, "start", "use_block"]).filter("low <> use_block OR high <> use_block")
    hit = hit.select(GROUP, F.col("start").alias("def_block"), "use_block")
    third = apart.join(hit, [GROUP, "def_block", "use_block"], "left_semi")
    names = pairs.columns
    found = nxt.select(names).unionByName(in_use.select(names)).unionByName(in_def.select(names)).unionByName(third.select(names)).distinct()
    return keep(found, dealt) if dealt else found


def _dangers_met(edges: DataFrame, ways: DataFrame, danger: DataFrame) -> DataFrame:
    """(func_id, start, node, low, high): first and last by name of the danger blocks on ways to a node, the start's own left out.

    ``ways(func_id, node, start)``. A state is a node and what was met before it; two names tell whether there is one besides any given
    block, so the table has a row per way's node, however many dangers there are.
    """
    step = ways.withColumnRenamed("node", "src").join(edges, [GROUP, "src"])
    step = step.join(ways.withColumnRenamed("node", "dst"), [GROUP, "start", "dst"], "left_semi")
    met = keep(ways.join(danger, [GROUP, "node"], "left_semi").filter("node <> start").select(GROUP, "start", "node"), edges._dealt)

    def at(node: str) -> Column:
        return F.struct("start", F.col(node).alias("node"))

    along = edge_table(step.select(GROUP, at("src").alias("src"), at("dst").alias("dst")), edges)
    start = met.select(GROUP, at("node").alias("node"), F.col("node").alias("label"))
    low = least(along, start).withColumnRenamed("label", "low")
    both = low.join(least(along, start, largest=True).withColumnRenamed("label", "high"), [GROUP, "node"])
    return both.select(GROUP, "node.start", "node.node", "low", "high")


def _next_danger(pairs: DataFrame, danger: DataFrame) -> DataFrame:
    """In-block pairs with the first danger at or after the definition."""
    # positions are negated, so that the next danger is the last one known
    points = pairs.select(GROUP, F.col("def_block").alias("block"), (-F.col("def_idx")).alias("p"), F.lit(1).alias("ask"), F.lit(None).cast("bigint").alias("at"))
    known = danger.select(GROUP, "block", (-F.col("idx")).alias("p"), F.lit(0).alias("ask"), F.col("idx").alias("at"))
    rows = Ordered(points.distinct().unionByName(known), [GROUP, "block"], ["p", "ask"]).last_known(F.col("at"), "next_idx", True)
    found = rows.filter("ask = 1").select(GROUP, F.col("block").alias("def_block"), (-F.col("p")).alias("def_idx"), "next_idx")
    return pairs.join(found, [GROUP, "def_block", "def_idx"])


def prune_phi_args(phi_args: DataFrame, dead_blocks: DataFrame) -> DataFrame:
    """Merge arguments whose predecessor block is not among ``dead_blocks(func_id, node)``."""
    return phi_args.join(dead_blocks.select(GROUP, F.col("node").alias("pred_block")), [GROUP, "pred_block"], "left_anti")


def dead_paths(edges: DataFrame, roots: DataFrame, nodes: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, dead edges, dead blocks) for branches on a constant.

    ``edges(func_id, src, dst, kind)``; ``conditions(func_id, src, holds)`` gives the constant outcome of a block's branch. The edge of
    the other outcome goes, its sibling becomes unconditional, and blocks that the root then no longer reaches go with their edges.
    """
    named = edges.join(conditions, [GROUP, "src"], "left")
    wrong = F.coalesce(((F.col("kind") == "true") & ~F.col("holds")) | ((F.col("kind") == "false") & F.col("holds")), F.lit(False))
    marked = keep(named.withColumn("dead", wrong))
    left = marked.filter("NOT dead")
    seen = keep(propagate(roots.select(GROUP, F.col("root").alias("node")), edge_table(left)))
    gone = nodes.join(seen, [GROUP, "node"], "left_anti")
    kind = F.when(F.col("holds").isNotNull() & F.col("kind").isin("true", "false"), "unconditional").otherwise(F.col("kind"))
    left = left.join(seen.withColumnRenamed("node", "src"), [GROUP, "src"], "left_semi").select(GROUP, "src", "dst", kind.alias("kind"))
    return left, marked.filter("dead").select(GROUP, "src", "dst", "kind"), gone


def dead_loops(edges: DataFrame, dom: DataFrame, branches: DataFrame, phi_values: DataFrame) -> DataFrame:
    """(func_id, src, dst, kind): loop exits, or entries, that the first visit never takes.

    ``branches(func_id, src, var, constant, equal)``: the branch of ``src`` tests ``var`` for (in)equality with a constant.
    ``phi_values(func_id, var, pred_block, value)``: what the merge row of ``var`` gets from where, value null unless constant. With one
    upstream value, that is, from the block itself or one it does not dominate, the test is decided; its losing edge goes if the
    winning one never leads back.
    """
    asked = branches.join(phi_values, [GROUP, "var"])
    below = tree_of(dom).above(asked.select(GROUP, "src", "pred_block").distinct(), "src", "pred_block")
    up = asked.join(below.withColumn("below", F.lit(True)), [GROUP, "src", "pred_block"], "left").filter("pred_block = src OR below IS NULL")
    up = up.groupBy(GROUP, "src", "constant", "equal").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value")).filter("n = 1 AND value IS NOT NULL")
    won = (F.col("value") == F.col("constant")) == F.col("equal")
    decided = keep(up.select(GROUP, "src", F.when(won, "true").otherwise("false").alias("taken")))
    out = keep(edges.filter("kind IN ('true', 'false')").join(decided, [GROUP, "src"]))
    starts = out.filter("kind = taken").select(GROUP, F.col("dst").alias("node"), F.col("src").alias("start")).distinct()
    back = propagate(starts, edge_table(edges), tags=["start"]).filter("node = start").select(GROUP, F.col("start").alias("src"))
    return out.filter("kind <> taken").join(back, [GROUP, "src"], "left_anti").select(GROUP, "src", "dst", "kind")


def backward_slice(depends: DataFrame, seeds: DataFrame, stop: DataFrame) -> DataFrame:
    """(func_id, seed, node, depth): from every seed backwards along ``depends(func_id, node, on)`` the nearest stop, ties by name."""
    edges = edge_table(depends.select(GROUP, F.col("node").alias("src"), F.col("on").alias("dst")))
    stop = keep(stop.select(GROUP, "node").distinct())
    walk = propagate(seeds.select(GROUP, "node", F.col("node").alias("seed")), edges, tags=["seed"], stop=stop, depth="depth")
    hits = walk.join(stop, [GROUP, "node"], "left_semi")
    near = hits.groupBy(GROUP, "seed").agg(F.min(F.struct("depth", "node")).alias("m"))
    return near.select(GROUP, "seed", "m.node", "m.depth")


def call_edges(instr: DataFrame) -> DataFrame:
    """(caller, callee, n) from call rows ``(caller, callee)``."""
    return instr.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n"))
