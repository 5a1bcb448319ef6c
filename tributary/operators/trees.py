"""Trees stored as rows: ``nodes(func_id, node, parent, pos, …)``, folded level by level from the leaves.

A round takes up all nodes whose children are done and combines those children in a grouped aggregate, which pre-aggregates before the
shuffle: a node may have any number of children.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tributary import fixpoint
from tributary.fixpoint import GROUP, buckets
from tributary.functions.scalar import BIG, fold_constants
from tributary.operators import forms
from tributary.operators.forms import COMMUTATIVE, LOGICAL, SHIFTS
from tributary.tables import Rounds, cut, keep


def fold_tree(
    nodes: DataFrame, leaf: Sequence[Column], aggs: Sequence[Column], inner: Sequence[Column] | Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Every node with results: ``leaf`` for nodes without children, ``inner`` over payload and ``aggs`` of the children for others.

    ``leaf`` and ``inner`` name the same results; ``inner`` may be a function that adds them in several steps. ``aggs`` see the
    children's columns and results.
    """
    total, most = nodes.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    # small trees are stored in buckets, and folded without a further shuffle
    dealt = buckets(nodes.sparkSession, total) if total and total > fixpoint.DEAL and most <= fixpoint.GRAPH else 0
    nodes = keep(nodes, dealt) if dealt else nodes
    counts = nodes.filter("parent IS NOT NULL").groupBy(GROUP, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_need"))
    columns = nodes.columns
    nodes = keep(nodes.join(counts, [GROUP, "node"], "left"), dealt)
    inner_nodes = nodes.filter("_need IS NOT NULL")
    rounds = Rounds(dealt)
    done, n = rounds.add(nodes.filter("_need IS NULL").select(*columns, *leaf))
    schema, pending = done.schema, done
    while n:
        kids = pending.filter("parent IS NOT NULL").groupBy(GROUP, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_have"), *aggs)
        now = inner_nodes.join(kids, [GROUP, "node"])
        ready = now.filter("_need = _have").drop("_need", "_have")
        ready = inner(ready) if callable(inner) else ready.select(*columns, *inner)
        # the written rounds share one schema, whatever type an expression widens to
        done, n = rounds.add(ready.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]))
        # children whose parent still waits for others stay for the next round
        late, n_late, _ = cut(now.filter("_need <> _have").select(GROUP, F.col("node").alias("parent")), dealt=dealt)
        pending = done.unionByName(pending.join(late, [GROUP, "parent"], "left_semi").select(*done.columns)) if n_late else done
    return rounds.all()


def complexity(nodes: DataFrame) -> DataFrame:
    """Nodes with ``complexity``: the number of leaves below, a leaf being its own."""
    return fold_tree(
        nodes, [F.lit(1).cast("bigint").alias("complexity")], [F.sum("complexity").alias("_c")], [F.col("_c").alias("complexity")]
    )


def _digest(text: Column) -> list[Column]:
    """Two whole numbers of 60 bits from a text."""
    digits = F.sha2(text, 256)
    return [F.conv(F.substring(digits, at, 15), 16, 10).cast(BIG) for at in (1, 16)]


def tree_fingerprint(nodes: DataFrame) -> DataFrame:
    """Nodes with ``fp``: equal exactly for equal trees, up to hash collisions. ``label`` is the node's own content, ``pos`` the place of a
    child; where order does not matter (the sides of a branch) all children have the same place.

    Children enter as a sum of digests, not as a list, so that a node with very many of them needs no more room than one with two.
    """
    a, b = _digest(F.concat_ws(":", F.col("pos").cast("string"), "fp"))
    text = F.concat_ws("|", "label", F.col("_n").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string"))
    return fold_tree(
        nodes,
        [F.sha2(F.concat_ws("|", "label", F.lit("0")), 256).alias("fp")],
        [F.count(F.lit(1)).alias("_n"), F.sum(a).alias("_a"), F.sum(b).alias("_b")],
        [F.sha2(text, 256).alias("fp")],
    )


PENALTY = 0.9
OPAQUE = ("call", "address", "dereference", "member_access")


def dependency_scores(nodes: DataFrame) -> DataFrame:
    """(func_id, root, var, score): how much a tree's value depends on each variable.

    ``nodes(func_id, node, parent, op, var)``: a variable counts 1; an operation splits evenly among the operands that hold variables at
    all and keeps 0.9 of it; calls, addresses, dereferences and members hide what is below. Shares add up per variable.
    """
    nodes = nodes.select(GROUP, "node", "parent", "op", "var")
    opaque = F.coalesce(F.col("op").isin(*OPAQUE), F.lit(False))
    shares = fold_tree(
        nodes,
        [F.col("var").isNotNull().alias("holds"), F.lit(0).cast("bigint").alias("ways")],
        [F.count_if("holds").alias("_w")],
        [((F.col("_w") > 0) & ~opaque).alias("holds"), F.col("_w").alias("ways")],
    )
    dealt = getattr(shares, "_dealt", 0)
    shares = keep(shares.filter("holds"), dealt)
    # every share moves up on its own; equal ones meet and add up
    rounds = Rounds(dealt)
    frontier, n = rounds.add(shares.filter("var IS NOT NULL").select(GROUP, "node", "parent", "var", F.lit(1.0).alias("score")))
    up = shares.select(GROUP, F.col("node").alias("parent"), F.col("parent").alias("next"), "ways")
    while n:
        step = frontier.filter("parent IS NOT NULL").join(up, [GROUP, "parent"])
        step = step.select(GROUP, F.col("parent").alias("node"), F.col("next").alias("parent"), "var", (F.col("score") / F.col("ways") * PENALTY).alias("score"))
        step = step.groupBy(GROUP, "node", "parent", "var").agg(F.sum("score").alias("score"))
        frontier, n = rounds.add(step)
    ends = rounds.all().filter("parent IS NULL")
    return ends.groupBy(GROUP, F.col("node").alias("root"), "var").agg(F.sum("score").alias("score"))


#: Groups up to so many nodes are simplified where they lie, whole groups at a time; larger ones level by level.
TOGETHER = 10_000

# what is known of a simplified expression: its value if constant, its text, and, for ``base op constant``, these three
FORM = "struct<c:decimal(38,0),print:string,chain:string,base:string,k:decimal(38,0)>"


def _form(c: str = "NULL", text: str = "NULL", chain: str = "NULL", base: str = "NULL", k: str = "NULL") -> str:
    return f"CAST(named_struct('c', {c}, 'print', {text}, 'chain', {chain}, 'base', {base}, 'k', {k}) AS {FORM})"


def _among(names: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def canonical_expressions(nodes: DataFrame, size: int = 32, signed: bool = True, counts: DataFrame | None = None, roots: bool = False) -> DataFrame:
    """Nodes with ``print`` and ``fp``: the same for computations that simplify to the same form.

    ``nodes(func_id, node, parent, pos, op, var, value)``: leaves have ``var`` or ``value``, operations any number of operands from 0 on.
    The rules below hold for one and two; of longer lists the operands behind the second stand in the form by number and digest. Names that
    could be taken for a number or an operation are quoted.
    Constants go to the right of commutative operations and are folded, along chains too; a - b is a + (-b); double negation, neutral
    and absorbing constants, operations of a value with itself, and a dereferenced address vanish.

    A row may also hold some nodes of a group, ``nodes(func_id, nodes array<struct<node, parent, …>>)``; the result has one row per node.
    ``counts(func_id, n)``: the nodes of every group, where the caller knows them without making all nodes. ``roots``: only nodes without
    parent are wanted.
    """
    many = forms.packed(nodes)
    if counts is None:
        counts = nodes.groupBy(GROUP).agg(F.sum(F.size(forms.NODES) if many else F.lit(1)).alias("n"))
    large, n_large, _ = cut(counts.filter(F.col("n") > TOGETHER).select(GROUP))
    out = forms.fold(nodes.join(large, GROUP, "left_anti") if n_large else nodes, size, signed, roots)
    if n_large:
        rest = nodes.join(large, GROUP, "left_semi")
        rest = _by_levels(rest.select(GROUP, F.inline(forms.NODES)) if many else rest, size, signed)
        out = out.unionByName(rest.filter("parent IS NULL") if roots else rest)
    return out.withColumn("fp", F.sha2("print", 256))


def _by_levels(nodes: DataFrame, size: int, signed: bool) -> DataFrame:
    """Nodes with ``print``, folded from the leaves: the rules of ``forms.simplified`` as columns."""
    commuting = f"_op IN {_among(COMMUTATIVE)}"

    def const(value: str) -> str:
        return _form(c=value, text=f"CAST({value} AS STRING)")

    def neutral(value: str) -> str:
        zero = _among(("plus", "bitwise_or", "bitwise_xor", "logical_or", *SHIFTS))
        one = _among(("multiply", "multiply_us", "divide", "divide_us"))
        return f"((_op IN {zero} AND {value} = 0) OR (_op IN {one} AND {value} = 1) OR (_op = 'logical_and' AND {value} <> 0))"

    def chained(base: str, k: str) -> str:
        absorbed = f"_op IN ('multiply', 'bitwise_and') AND {k} = 0"
        whole = _form(text=f"concat(_op, '(', {base}, ',', {k}, ')')", chain="_op", base=base, k=k)
        return f"CASE WHEN {absorbed} THEN {const('0')} WHEN {neutral(k)} THEN {_form(text=base)} ELSE {whole} END"

    def simplified(df: DataFrame) -> DataFrame:
        # a - b becomes a + (-b)
        df = df.withColumn("_neg", F.expr("op = 'minus' AND _r IS NOT NULL"))
        df = df.withColumn("_n0", F.expr("IF(op = 'negate', _l, _r)")).withColumns({"_c": F.col("_n0.c"), "_negate": F.lit("negate")})
        df = fold_constants(df, "_negate", "_c", "_c", "_minus", size, signed)
        undone = _form(text="substring(_n0.print, 8, length(_n0.print) - 8)")
        turned = f"CASE WHEN _c IS NOT NULL THEN {const('_minus')} WHEN startswith(_n0.print, 'negate(') THEN {undone} ELSE {_form(text="concat('negate(', _n0.print, ')')")} END"
        df = df.withColumn("_turned", F.expr(turned))
        df = df.withColumns({"_op": F.expr("IF(_neg, 'plus', op)"), "_y": F.expr("IF(_neg, _turned, _r)")})
        # constants to the right
        df = df.withColumn("_swap", F.expr(f"({commuting} OR _op IN {_among(LOGICAL)}) AND _l.c IS NOT NULL AND _y.c IS NULL AND _y IS NOT NULL"))
        df = df.withColumns({"_x": F.expr("IF(_swap, _y, _l)"), "_z": F.expr("IF(_swap, _l, _y)")})
        df = df.withColumns({"_xc": F.expr("_x.c"), "_zc": F.expr("_z.c"), "_unary": F.expr("_z IS NULL")})
        # constants of both sides, and of chains of the same operation
        df = df.withColumns(
            {
                "_xk": F.expr(f"IF({commuting} AND _x.chain = _op, _x.k, NULL)"),
                "_zk": F.expr(f"IF({commuting} AND _z.chain = _op, _z.k, NULL)"),
            }
        )
        df = df.withColumns(
            {
                "_k2": F.expr("coalesce(_zc, _zk)"),
                "_xb": F.expr("IF(_xk IS NULL, _x.print, _x.base)"),
                "_zb": F.expr("IF(_zk IS NULL, _z.print, _z.base)"),
            }
        )
        df = df.withColumns({"_u2": F.expr("IF(_unary, _xc, _zc)")})
        df = fold_constants(df, "_op", "_xc", "_u2", "_both", size, signed)
        df = fold_constants(df, "_op", "_xk", "_k2", "_chain", size, signed)
        df = df.withColumn("_k", F.expr("IF(_xk IS NOT NULL AND _k2 IS NOT NULL, _chain, coalesce(_xk, _k2))"))
        text = "concat(_op, '(', _x.print, IF(_unary, '', ','), IF(_unary, '', _z.print), ')')"
        longer = "concat(op, '(', coalesce(_l.print, ''), ',', coalesce(_r.print, ''), ';', _more, ':', _d0, ':', _d1, ')')"
        value = f"""CASE
            WHEN _more > 0 THEN {_form(text=longer)}
            WHEN op = 'negate' THEN _turned
            WHEN _unary AND _xc IS NOT NULL AND _both IS NOT NULL THEN {const('_both')}
            WHEN _unary AND op = 'dereference' AND startswith(_x.print, 'address(') THEN {_form(text="substring(_x.print, 9, length(_x.print) - 9)")}
            WHEN _unary THEN {_form(text=text)}
            WHEN _xc IS NOT NULL AND _zc IS NOT NULL AND _op = 'logical_and' THEN {const("IF(_xc <> 0 AND _zc <> 0, 1, 0)")}
            WHEN _xc IS NOT NULL AND _zc IS NOT NULL AND _op = 'logical_or' THEN {const("IF(_xc <> 0 OR _zc <> 0, 1, 0)")}
            WHEN _xc IS NOT NULL AND _zc IS NOT NULL AND _both IS NOT NULL THEN {const('_both')}
            WHEN _xc IS NULL AND _zc IS NOT NULL AND {neutral('_zc')} THEN _x
            WHEN _xc IS NULL AND _zc = 0 AND _op IN ('multiply', 'multiply_us', 'bitwise_and', 'logical_and') THEN {const('0')}
            WHEN _xc IS NULL AND _zc <> 0 AND _op = 'logical_or' THEN {const('1')}
            WHEN _xc IS NULL AND _zc IS NOT NULL AND {commuting} THEN {chained('_xb', '_k')}
            WHEN _x.print = _z.print AND _op IN ('bitwise_or', 'bitwise_and', 'logical_or', 'logical_and') THEN _x
            WHEN _x.print = _z.print AND _op = 'bitwise_xor' THEN {const('0')}
            WHEN _xc IS NULL AND _zc IS NULL AND {commuting} AND _k IS NOT NULL THEN {chained("concat(_op, '(', _xb, ',', _zb, ')')", '_k')}
            ELSE {_form(text=text)} END"""
        return df.withColumn("form", F.expr(value))

    name = "IF(var RLIKE '^[A-Za-z_.$@#][^(),;`]*$', var, concat('`', replace(var, '`', '``'), '`'))"
    leaf = F.expr(f"IF(value IS NOT NULL, {const('value')}, {_form(text=name)})")
    behind = F.col("pos") >= 2
    # sums of digests by place: a list of any length is added up before the shuffle
    digests = _digest(F.concat_ws(":", "pos", "form.print"))
    rest = [F.sum(F.when(behind, d)).cast("string").alias(f"_d{i}") for i, d in enumerate(digests)]
    out = fold_tree(
        nodes,
        [leaf.alias("form")],
        [F.max_by("form", F.when(F.col("pos") == 0, 1)).alias("_l"), F.max_by("form", F.when(F.col("pos") == 1, 1)).alias("_r"), F.count_if(behind).alias("_more"), *rest],
        simplified,
    )
    return out.select(*nodes.columns, F.col("form.print").alias("print"))
