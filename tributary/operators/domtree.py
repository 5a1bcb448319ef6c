"""Dominator trees with ancestor jump tables: one row per node and level instead of one per node and dominator.

Level ``d`` of the jump tables holds the ancestors ``1 .. 16`` times ``16**d`` steps above a node, in one row. A walk of any length is one lookup per
hexadecimal digit of it, so questions about ancestors take as many joins as the depth has such digits, whatever the number of pairs asked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tributary.fixpoint import DEAL, GROUP, edge_table, hops, jump, propagate  # noqa: F401 (tests set DEAL here, too)
from tributary.functions.ordered import Ordered
from tributary.operators import orders
from tributary.tables import Rounds, cut, keep

RADIX, DIGIT = 16, 4
#: Nodes are contracted into their only predecessor while this share of the nodes has one.
SINGLES = 0.5
#: Rounds of a search that is tried without contraction.
SHALLOW = 10


class Forest:
    """``parents(func_id, node, parent)``, parent null at a root, with depth (roots at 1) and jump tables."""

    def __init__(self, parents: DataFrame, dealt: int = 0):
        #: the number of buckets by graph, where the graphs are dealt out, see ``fixpoint.edge_table``
        self.dealt = dealt
        level = parents.select(GROUP, "node", F.col("parent").alias("u1"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("s"))
        self.levels: list[DataFrame] = []
        self._places: DataFrame | None = None
        while True:
            level, n, _ = cut(self._doubled(level), F.col(f"u{RADIX}").isNotNull(), dealt)
            self.levels.append(level)
            if not n:
                break
            level = level.select(GROUP, "node", F.col(f"u{RADIX}").alias("u1"), "s")
        depth = level.select(GROUP, "node", (F.col("s") + 1).alias("depth"))
        above = self.levels[0].select(GROUP, "node", F.col("u1").alias("parent"), "s")
        #: (func_id, node, parent, depth)
        self.nodes = keep(above.join(depth, [GROUP, "node"]).drop("s"), dealt) if len(self.levels) > 1 else above.withColumn("depth", F.col("s") + 1).drop("s")
        self.nodes._dealt = dealt

    @staticmethod
    def _doubled(level: DataFrame) -> DataFrame:
        """From the first step of a level to all of its steps; ``s`` counts the ancestors up to the last."""
        for have in (1 << i for i in range(DIGIT)):
            known = [f"u{i}" for i in range(1, have + 1)]
            more = level.select(
                GROUP, F.col("node").alias(f"u{have}"), *[F.col(u).alias(f"u{have + i}") for i, u in enumerate(known, 1)], F.col("s").alias("t")
            )
            level = level.join(more, [GROUP, f"u{have}"], "left").select(
                GROUP, "node", *known, *[f"u{have + i}" for i in range(1, have + 1)], (F.col("s") + F.coalesce("t", F.lit(0))).alias("s")
            )
        return level

    def _at(self, rows: DataFrame, column: str, digit: int, steps: list[str]) -> DataFrame:
        """``rows`` with the jumps of ``column`` on one level."""
        table = self.levels[digit].select(GROUP, F.col("node").alias(column), *[F.col(f"u{i}").alias(s) for i, s in enumerate(steps, 1)])
        return rows.join(table, [GROUP, column], "left")

    def lifted(self, rows: DataFrame, column: str, by: Column) -> DataFrame:
        """``rows`` with ``column`` replaced by its ancestor so many steps above; a null there stays null."""
        names, given = [f"_u{i}" for i in range(1, RADIX)], rows.columns
        rows = rows.withColumn("_by", by)
        for digit in range(len(self.levels)):
            part = (F.shiftright("_by", DIGIT * digit)) % RADIX
            rows = self._at(rows, column, digit, names)
            rows = rows.withColumn(column, reduce(lambda out, i: out.when(part == i, F.col(names[i - 1])), range(1, RADIX), F.when(part == 0, F.col(column)))).drop(*names)
        return rows.select(given)

    def above(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """``pairs`` in which ``a`` is ``b`` or an ancestor of it."""
        given = pairs.columns
        nodes = self.nodes.select(GROUP, "node", "depth")
        rows = pairs.join(nodes.select(GROUP, F.col("node").alias(a), F.col("depth").alias("_da")), [GROUP, a])
        rows = rows.join(nodes.select(GROUP, F.col("node").alias(b), F.col("depth").alias("_db")), [GROUP, b]).filter("_da <= _db")
        rows = rows.withColumn("_up", F.col(b))
        rows = self.lifted(rows, "_up", F.col("_db") - F.col("_da")).filter(F.col("_up") == F.col(a)).select(given)
        return keep(rows, self.dealt) if self.dealt else rows

    def meet(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """``pairs`` with ``meet``, the nearest common ancestor of nodes ``a`` and ``b`` (null where they share no root), and ``meet_depth``."""
        given = pairs.columns
        rows = pairs.withColumns({"_a": F.col(a), "_b": F.col(b)})
        nodes = self.nodes.select(GROUP, "node", "depth")
        for side in ("a", "b"):
            rows = rows.join(nodes.select(GROUP, F.col("node").alias(f"_{side}"), F.col("depth").alias(f"_d{side}")), [GROUP, f"_{side}"])
        deeper = F.col("_da") > F.col("_db")
        rows = rows.withColumns({"_a": F.when(deeper, F.col("_a")).otherwise(F.col("_b")), "_b": F.when(deeper, F.col("_b")).otherwise(F.col("_a")), "_more": F.abs(F.col("_da") - F.col("_db"))})
        rows = rows.withColumn("_depth", F.least("_da", "_db")).drop("_da", "_db")
        rows = self.lifted(rows, "_a", F.col("_more")).drop("_more")
        up_a, up_b = ([f"_{side}{i}" for i in range(1, RADIX)] for side in "ab")
        for digit in reversed(range(len(self.levels))):
            rows = self._at(self._at(rows, "_a", digit, up_a), "_b", digit, up_b)
            # the longest jump that still keeps both apart
            apart = [F.col(x) != F.col(y) for x, y in zip(up_a, up_b)]
            chosen = {c: reduce(lambda out, i: out.when(apart[i], F.col(names[i])), reversed(range(RADIX - 2)), F.when(apart[-1], F.col(names[-1]))).otherwise(F.col(c)) for c, names in (("_a", up_a), ("_b", up_b))}
            taken = reduce(lambda out, i: out.when(apart[i], i + 1), reversed(range(RADIX - 2)), F.when(apart[-1], RADIX - 1)).otherwise(0)
            rows = rows.withColumns({**chosen, "_depth": F.col("_depth") - taken * RADIX**digit}).drop(*up_a, *up_b)
        rows = self._at(rows, "_a", 0, ["_p"])
        same = F.col("_a") == F.col("_b")
        meet_depth = F.when(same, F.col("_depth")).when(F.col("_p").isNotNull(), F.col("_depth") - 1)
        return rows.select(*given, F.when(same, F.col("_a")).otherwise(F.col("_p")).alias("meet"), meet_depth.alias("meet_depth"))

    def common(self, groups: DataFrame, by: list[str], node: str) -> DataFrame:
        """(*by, meet, meet_depth): the nearest common ancestor of all ``node`` of a group, null where they share no root."""
        first = groups.groupBy(*by).agg(F.min(node).alias("_first"))
        rows = self.meet(groups.join(first, by), "_first", node)
        # all of these lie above the first node, so the highest one lies above all
        top = F.min(F.struct(F.coalesce("meet_depth", F.lit(0)).alias("d"), "meet")).alias("_m")
        return keep(rows.groupBy(*by).agg(top).select(*by, F.col("_m.meet").alias("meet"), F.col("_m.d").alias("meet_depth")), self.dealt)

    def places(self) -> DataFrame:
        """(func_id, node, place, leave): subtrees as intervals."""
        if self._places is None:
            self._places = keep(orders.places(self.nodes.select(GROUP, "node", "parent"), self.dealt), self.dealt)
        return self._places

    def nearest(self, points: DataFrame, marks: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
        """(points with ``at``, marks with ``above``): the nearest marked node above a point or at it, and the nearest one above a mark.

        ``points`` and ``marks`` are (func_id, node, *by), each row once; marks count for points of the same ``by``. Null where there is none. Marks open
        and close along the walk around the tree: a point asks for the last of these events. An opening is the answer; a closing has the
        answer of the mark that closed, which is followed by pointer jumping.
        """
        key = [GROUP, *by]
        place = self.places()
        marks = keep(marks.select(*key, "node").join(place, [GROUP, "node"]), self.dealt)
        points = keep(points.select(*key, "node").join(place.drop("leave"), [GROUP, "node"]), self.dealt)
        none = F.lit(None).cast("boolean")
        opened = marks.select(*key, "node", F.col("place").alias("t"), F.lit(0).alias("turn"), F.lit(False).alias("closes"))
        closed = marks.select(*key, "node", F.col("leave").alias("t"), F.lit(0).alias("turn"), F.lit(True).alias("closes"))
        asking = points.select(*key, "node", F.col("place").alias("t"), F.lit(1).alias("turn"), none.alias("closes"))
        event = F.when(F.col("closes").isNotNull(), F.struct(F.col("node").alias("mark"), F.col("closes").alias("gone")))
        seen = keep(Ordered(opened.unionByName(closed).unionByName(asking), key, ["t", "turn"]).last_known(event, "before", False), self.dealt)
        around = seen.filter("closes = false").select(*key, "node", "before")
        tag = F.struct(*by, "node")
        beside = F.when(F.col("before.gone"), F.struct(*by, F.col("before.mark").alias("node"))).otherwise(tag)
        first = jump(around.select(GROUP, tag.alias("node"), beside.alias("parent")), self.dealt).select(GROUP, "node", F.col("parent").alias("first"))
        direct = around.select(GROUP, tag.alias("first"), F.when(~F.col("before.gone"), F.col("before.mark")).alias("above"))
        above = keep(first.join(direct, [GROUP, "first"]).select(GROUP, *[F.col(f"node.{c}").alias(c) for c in [*by, "node"]], "above"), self.dealt)
        asked = seen.filter("turn = 1").withColumn("_mark", F.col("before.mark"))
        asked = asked.join(above.select(*key, F.col("node").alias("_mark"), F.col("above").alias("_above")), [*key, "_mark"], "left")
        at = F.when(F.col("before.gone"), F.col("_above")).otherwise(F.col("_mark"))
        asked = asked.select(*key, "node", at.alias("at"))
        return keep(asked, self.dealt) if self.dealt else asked, above

    def relation(self) -> DataFrame:
        """(func_id, node, dom, pos): every node with itself and all its ancestors; ``pos`` counts from the root at 0."""
        rows = self.nodes.select(GROUP, "node", F.col("node").alias("dom"), (F.col("depth") - 1).alias("pos"))
        names = [f"_u{i}" for i in range(1, RADIX)]
        for digit in range(len(self.levels)):
            here = [F.struct(F.col(n).alias("dom"), (F.col("pos") - i * RADIX**digit).alias("pos")) for i, n in enumerate(["dom", *names])]
            rows = self._at(rows, "dom", digit, names).select(GROUP, "node", F.explode(F.filter(F.array(*here), lambda x: x["dom"].isNotNull())).alias("x"))
            rows = rows.select(GROUP, "node", "x.dom", "x.pos")
        return rows


def _searched(between: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame | None:
    """(func_id, node, parent): by breadth from the roots along ``between(func_id, src, dst, p)``, where ``p`` names the parent to note; None if that
    takes more rounds. A round makes several hops while little is found."""
    dealt = getattr(between, "_dealt", 0)
    stays = between.select(GROUP, F.col("dst").alias("src"), "dst").distinct().withColumn("p", F.lit(None).cast(between.schema["p"].dataType))
    along = keep(between.unionByName(stays), dealt)

    def hop(rows: DataFrame, edges: DataFrame) -> DataFrame:
        step = rows.withColumnRenamed("node", "src").join(edges, [GROUP, "src"])
        stay = F.col("src") == F.col("dst")
        way = F.struct(F.when(stay, F.col("depth")).otherwise(F.col("depth") + 1).alias("depth"), F.when(stay, F.col("parent")).otherwise(F.col("p")).alias("parent"))
        return step.groupBy(GROUP, F.col("dst").alias("node")).agg(F.min(way).alias("w")).select(GROUP, "node", "w.parent", "w.depth")

    start = roots.select(GROUP, "node", F.lit(None).cast(between.schema["p"].dataType).alias("parent"), F.lit(0).alias("depth"))
    done = Rounds(dealt)
    frontier, n = done.add(start)
    while n:
        if rounds is not None and done.n > rounds:
            return None
        found = hop(frontier, between)
        for _ in range(hops(n, dealt) - 1):
            found = hop(found, along)
        frontier, n = done.add(found.join(done.all().select(GROUP, "node"), [GROUP, "node"], "left_anti"))
    return done.all().drop("depth")


def spanning_tree(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, bool]:
    """(func_id, node, parent): a tree of edges over all that ``roots(func_id, node)`` reach, parent null at the roots; and whether it is shallow.

    A search by breadth, if it ends soon. In graphs with long ways nodes with a single predecessor are first taken into it, whole chains at a time by pointer
    jumping, and again what then has a single predecessor, as long as that concerns half of the nodes: long chains and nested loops shrink in few rounds.
    """
    between = keep(edges.filter("src <> dst").select(GROUP, "src", "dst", F.col("src").alias("p")), getattr(edges, "_dealt", 0))
    found = _searched(between, roots, SHALLOW)
    if found is not None:
        return found, True
    heads, chosen = None, None
    while True:
        into = between.groupBy(GROUP, F.col("dst").alias("node")).agg(F.min("src").alias("low"), F.max("src").alias("high"), F.min("p").alias("p"))
        into, n, _ = cut(into.join(roots, [GROUP, "node"], "left_anti"), F.col("low") == F.col("high"))
        if not n or n < SINGLES * into.count():
            break
        single = into.filter("low = high")
        tops = jump(single.select(GROUP, "node", F.col("low").alias("parent"))).select(GROUP, "node", F.col("parent").alias("top"))
        # what waits for itself in a ring is on no way from a root, and stays
        tops, n, _ = cut(tops.join(single.select(GROUP, F.col("node").alias("top")), [GROUP, "top"], "left_anti"))
        if not n:
            break
        taken = single.join(tops, [GROUP, "node"]).select(GROUP, "node", F.col("p").alias("parent"))
        chosen = keep(taken if chosen is None else chosen.unionByName(taken))
        if heads is None:
            nodes = edges.select(GROUP, F.explode(F.array("src", "dst")).alias("node")).unionByName(roots.select(GROUP, "node")).distinct()
            heads = nodes.withColumn("head", F.col("node"))
        heads = heads.join(tops.withColumnRenamed("node", "head"), [GROUP, "head"], "left")
        heads = keep(heads.select(GROUP, "node", F.coalesce("top", "head").alias("head")))
        moved = between.join(tops.select(GROUP, F.col("node").alias("src"), F.col("top").alias("a")), [GROUP, "src"], "left")
        moved = moved.join(tops.select(GROUP, F.col("node").alias("dst"), F.col("top").alias("b")), [GROUP, "dst"], "left")
        moved = moved.select(GROUP, F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "p").filter("src <> dst")
        between = keep(moved.groupBy(GROUP, "src", "dst").agg(F.min("p").alias("p")))
    found = _searched(between, roots)
    if heads is None:
        return found, False
    reached = heads.join(found.select(GROUP, F.col("node").alias("head")), [GROUP, "head"], "left_semi").select(GROUP, "node")
    up = found.filter("parent IS NOT NULL").unionByName(chosen)
    return keep(reached.join(up, [GROUP, "node"], "left").select(GROUP, "node", "parent")), False


def dominator_tree(edges: DataFrame, roots: DataFrame) -> Forest:
    """The dominator tree of every graph, over the nodes that its roots reach; several roots have no common dominator.

    Dominators are among the ancestors in any spanning tree. In a shallow one (some thirty levels) all ancestors are listed, and those
    taken away that some other way round avoids: a candidate fails at a node if a predecessor lacks it, and a failure is passed on along edges up to
    the candidate itself. In a deep one nothing is listed, see ``_narrowed``.
    """
    edges = edge_table(edges)
    roots = keep(roots.select(GROUP, F.col("root").alias("node")).distinct(), edges._dealt)
    parents, shallow = spanning_tree(edges, roots)
    dealt = edges._dealt if shallow else 0
    into = edges.filter("src <> dst").join(parents.select(GROUP, F.col("node").alias("src")), [GROUP, "src"], "left_semi")
    if not shallow:
        return _narrowed(into, roots, parents)
    first = keep(Forest(parents, dealt).relation(), dealt)
    strict = first.filter("node <> dom").select(GROUP, "node", "dom")
    strict._dealt = dealt
    held = first.select(GROUP, F.col("node").alias("src"), "dom")
    failed = into.withColumnRenamed("dst", "node").join(strict, [GROUP, "node"]).join(held, [GROUP, "src", "dom"], "left_anti").select(GROUP, "node", "dom")
    failed = propagate(failed, edges, tags=["dom"], within=strict)
    up = first.filter("node <> dom").join(failed, [GROUP, "node", "dom"], "left_anti").groupBy(GROUP, "node").agg(F.max_by("dom", "pos").alias("parent"))
    parents = keep(first.filter("node = dom").select(GROUP, "node").join(up, [GROUP, "node"], "left"), dealt)
    return Forest(parents, dealt)


def _narrowed(into: DataFrame, roots: DataFrame, parents: DataFrame) -> Forest:
    """The dominator tree from any spanning tree: a round gives every node with several predecessors the nearest common ancestor of these in the
    tree of the round before. Ancestors only get fewer, dominators stay among them, and a tree that no longer changes is the dominator tree. Well-nested
    graphs need two rounds.
    """
    into = into.select(GROUP, F.col("dst").alias("node"), "src").join(roots, [GROUP, "node"], "left_anti")
    several = into.groupBy(GROUP, "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(GROUP, "node")
    into, n, _ = cut(into.join(several, [GROUP, "node"], "left_semi"))
    while True:
        forest = Forest(parents)
        if not n:
            return forest
        now = forest.common(into, [GROUP, "node"], "src").select(GROUP, "node", F.col("meet").alias("better"), F.lit(True).alias("met"))
        new = parents.join(now, [GROUP, "node"], "left")
        new = new.select(GROUP, "node", F.when(F.col("met"), F.col("better")).otherwise(F.col("parent")).alias("parent"), (F.col("met") & ~F.col("better").eqNullSafe(F.col("parent"))).alias("moved"))
        parents, n, _ = cut(new, F.col("moved"))
        if not n:
            return forest
        parents = parents.drop("moved")
