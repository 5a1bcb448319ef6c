"""Numbers for nodes: levels, visiting order of a forest, and labels that rule most questions about ways out.

A label is a necessary condition: where it fails there is no way, where it holds a search decides. The levels rule out ways against the order of the
graph. The places of a spanning forest give every node the hull ``lo .. hi`` of the places of all it reaches; a way leads from the wider
to the narrower hull. Near-trees are decided by the hulls alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tributary.fixpoint import GROUP, LOGS, edge_table, jump, least
from tributary.functions.ordered import Ordered
from tributary.tables import Rounds, cut, keep, stored


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(func_id, node, level): length of a longest path from a root; null for nodes on or behind a cycle.

    Every round logs the edges that came in from nodes done just before, per node, and looks up only the nodes that got some.
    """
    edges = edge_table(edges)
    dealt = edges._dealt
    need = keep(edges.groupBy(GROUP, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("need")), dealt)
    done, logs, level = Rounds(dealt), Rounds(dealt), 0
    ready, n = done.add(nodes.join(need, [GROUP, "node"], "left_anti").select(GROUP, "node", F.lit(0).alias("level")))
    while n:
        level += 1
        came = edges.join(ready.select(GROUP, F.col("node").alias("src")), [GROUP, "src"]).groupBy(GROUP, F.col("dst").alias("node"))
        came, n = logs.add(came.agg(F.count(F.lit(1)).alias("have")))
        if not n:
            break
        if logs.n > LOGS:
            last, logs = logs, Rounds(dealt)
            logs.add(last.all().groupBy(GROUP, "node").agg(F.sum("have").alias("have")))
        have = logs.all().join(came.select(GROUP, "node"), [GROUP, "node"], "left_semi")
        have = have.groupBy(GROUP, "node").agg(F.sum("have").alias("have")).join(need, [GROUP, "node"]).filter("have = need")
        ready, n = done.add(have.select(GROUP, "node", F.lit(level).alias("level")))
    return nodes.join(done.all(), [GROUP, "node"], "left")


def places(parents: DataFrame, dealt: int = 0) -> DataFrame:
    """(func_id, node, place, leave): nodes of a forest ``parents(func_id, node, parent)`` numbered so that a subtree is the interval ``place .. leave``.

    A walk around the forest enters and leaves each node; whom it meets next is known per node, and pointer jumping counts the steps to the end.
    All numbers of a graph differ; the interval of a subtree of n nodes holds 2 n of them.
    """
    kids = parents.select(GROUP, F.struct("parent").alias("up"), "node")
    rows = keep(Ordered(kids, [GROUP, "up"], ["node"]).previous("node", "prev").select(GROUP, F.col("up.parent").alias("parent"), "node", "prev"), dealt)

    def at(column: str, leave: int) -> Column:
        return F.struct(F.lit(leave).alias("leave"), F.col(column).alias("of"))

    ends = rows.groupBy(GROUP, "parent").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    inner = ends.filter("parent IS NOT NULL")
    leaves = rows.select(GROUP, "node").join(inner.select(GROUP, F.col("parent").alias("node")), [GROUP, "node"], "left_anti")
    steps = (
        rows.filter("prev IS NOT NULL").select(GROUP, at("prev", 1).alias("node"), at("node", 0).alias("parent"))
        .unionByName(inner.select(GROUP, at("parent", 0).alias("node"), at("first", 0).alias("parent")))
        .unionByName(inner.select(GROUP, at("last", 1).alias("node"), at("parent", 1).alias("parent")))
        .unionByName(leaves.select(GROUP, at("node", 0).alias("node"), at("node", 1).alias("parent")))
        .unionByName(ends.filter("parent IS NULL").select(GROUP, at("last", 1).alias("node"), at("last", 1).alias("parent")))
    )
    ranked = jump(steps, dealt).groupBy(GROUP, F.col("node.of").alias("node"))
    sides = [F.max(F.when(F.col("node.leave") == i, -F.col("steps"))).cast("bigint").alias(n) for i, n in enumerate(("place", "leave"))]
    return ranked.agg(*sides)


class WayLabels:
    """(func_id, node, level, lo0, hi0, lo1, hi1) for the nodes of an acyclic graph, and what they say about a way from one to another."""

    def __init__(self, edges: DataFrame, level: DataFrame):
        above = level.select(GROUP, F.col("node").alias("src"), F.col("level").alias("a"))
        below = level.select(GROUP, F.col("node").alias("dst"), F.col("level").alias("b"))
        tight = edges.join(above, [GROUP, "src"]).join(below, [GROUP, "dst"]).filter("b = a + 1")
        tight = keep(tight.groupBy(GROUP, F.col("dst").alias("node")).agg(F.min("src").alias("p0"), F.max("src").alias("p1")))
        back = edge_table(edges.select(GROUP, F.col("dst").alias("src"), F.col("src").alias("dst")))
        table = level.select(GROUP, "node", "level")
        for i in (0, 1):
            forest = level.select(GROUP, "node").join(tight.select(GROUP, "node", F.col(f"p{i}").alias("parent")), [GROUP, "node"], "left")
            place = keep(places(forest).select(GROUP, "node", F.col("place").alias("label")))
            lo = least(back, place).withColumnRenamed("label", f"lo{i}")
            hi = least(back, place, largest=True).withColumnRenamed("label", f"hi{i}")
            table = table.join(lo, [GROUP, "node"]).join(hi, [GROUP, "node"])
        self.table = keep(table)

    NAMES = ("level", "lo0", "hi0", "lo1", "hi1")

    def of(self, rows: DataFrame, node: str, prefix: str) -> DataFrame:
        """``rows`` with the labels of ``node``, their names prefixed."""
        return rows.join(self.table.select(GROUP, F.col("node").alias(node), *[F.col(n).alias(prefix + n) for n in self.NAMES]), [GROUP, node])

    @staticmethod
    def possible(a: str, b: str) -> Column:
        """Whether the labels allow a way from ``a`` (prefix) to ``b``, or both may be the same node."""
        inside = (F.col(f"{a}lo0") <= F.col(f"{b}lo0")) & (F.col(f"{b}hi0") <= F.col(f"{a}hi0"))
        inside &= (F.col(f"{a}lo1") <= F.col(f"{b}lo1")) & (F.col(f"{b}hi1") <= F.col(f"{a}hi1"))
        return inside & (F.col(f"{a}level") <= F.col(f"{b}level"))


def _search(edges: DataFrame, asked: DataFrame, labels: WayLabels, start: str, end: str, possible: Callable[[str, str], Column]) -> DataFrame:
    """Pairs of ``asked(func_id, a, b)`` with a way of two edges or more, walked from ``start`` towards ``end``; at first around a direct edge."""
    spark = edges.sparkSession
    key = [GROUP, "a", "b"]
    targets = keep(labels.of(asked.select(*key), end, "t_"))

    def walked(rows: DataFrame) -> DataFrame:
        step = rows.withColumnRenamed("node", "src").join(edges, [GROUP, "src"]).withColumnRenamed("dst", "node").drop("src")
        step = labels.of(step.join(targets, key), "node", "n_").filter(possible("n_", "t_"))
        return step.select(*key, "node", (F.col("node") == F.col(end)).alias("there"))

    first = walked(asked.select(*key, F.col(start).alias("node"))).filter("NOT there")
    seen, n, path = cut(first.distinct())
    schema, paths, found, n_found = seen.schema, [path], [], 0
    frontier = seen
    while n:
        step = walked(frontier.select(*key, "node"))
        # a question is answered by its first arrival, and asked no further
        step = keep(step.distinct())
        hit, n, path = cut(step.filter("there").select(*key).distinct())
        if n:
            found.append(path)
        open_rows = step.filter("NOT there").join(hit, key, "left_anti")
        open_rows = open_rows.join(stored(spark, schema, paths), [*key, "node"], "left_anti")
        frontier, n, path = cut(open_rows.select(*key, "node", "there"))
        paths.append(path)
    return stored(spark, hit.schema, found) if found else asked.select(*key).limit(0)


def longer_ways(edges: DataFrame, level: DataFrame) -> DataFrame:
    """(func_id, a, b): edges of an acyclic graph between whose ends a way of two edges or more exists.

    Such a way takes its ends two levels apart or more, so other edges need no question. A question is walked from the end with fewer edges, through nodes
    whose labels allow the other end.
    """
    edges = edge_table(edges)
    a = level.select(GROUP, F.col("node").alias("a"), F.col("level").alias("la"))
    b = level.select(GROUP, F.col("node").alias("b"), F.col("level").alias("lb"))
    asked = edges.select(GROUP, F.col("src").alias("a"), F.col("dst").alias("b")).join(a, [GROUP, "a"]).join(b, [GROUP, "b"]).filter("lb > la + 1")
    asked, n, _ = cut(asked.select(GROUP, "a", "b"))
    if not n:
        return asked
    out = edges.groupBy(GROUP, F.col("src").alias("a")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(GROUP, F.col("dst").alias("b")).agg(F.count(F.lit(1)).alias("n_in"))
    asked = keep(asked.join(out, [GROUP, "a"]).join(into, [GROUP, "b"]))
    short = keep(_two_edges(edges, asked))
    asked, n, _ = cut(asked.join(short, [GROUP, "a", "b"], "left_anti"))
    if not n:
        return short
    labels = WayLabels(edges, level)
    back = edge_table(edges.select(GROUP, F.col("dst").alias("src"), F.col("src").alias("dst")))
    forward = _search(edges, asked.filter("n_out <= n_in"), labels, "a", "b", WayLabels.possible)
    backward = _search(back, asked.filter("n_out > n_in"), labels, "b", "a", lambda n, t: WayLabels.possible(t, n))
    return short.unionByName(forward.select(GROUP, "a", "b")).unionByName(backward.select(GROUP, "a", "b"))


def _two_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(func_id, a, b): of ``asked(func_id, a, b, n_out, n_in)`` what a way of two edges answers, looked for from the end with fewer edges. That takes the
    rows of a search's first step, and what it answers needs no labels."""
    key = [GROUP, "a", "b"]
    ahead = asked.filter("n_out <= n_in").select(*key).join(edges.select(GROUP, F.col("src").alias("a"), F.col("dst").alias("mid")), [GROUP, "a"])
    behind = asked.filter("n_out > n_in").select(*key).join(edges.select(GROUP, F.col("src").alias("mid"), F.col("dst").alias("b")), [GROUP, "b"])
    last = edges.select(GROUP, F.col("src").alias("mid"), F.col("dst").alias("b"))
    first = edges.select(GROUP, F.col("src").alias("a"), F.col("dst").alias("mid"))
    found = ahead.join(last, [GROUP, "mid", "b"], "left_semi").unionByName(behind.join(first, [GROUP, "a", "mid"], "left_semi").select(*ahead.columns))
    return found.select(*key).distinct()
