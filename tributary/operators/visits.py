"""Depth-first visits, which are sequential by definition: one graph after the other, many graphs at a time.

Graphs up to ``max_edges`` are visited whole, each in one call. Larger ones never come together in a task: they advance step by step in
joins, all at once, which is exact too but takes two rounds per node.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tributary.fixpoint import GROUP
from tributary.operators.dominance import tree_of
from tributary.tables import cut, keep

MAX_EDGES = 100_000


def dfs_order(edges: DataFrame, roots: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(func_id, node, parent, pre, post): numbers from 0 in the order of first and last touch; children by ``ord``, then name.

    The visit starts at the smallest root of a graph; a graph without one is not visited.
    """
    roots = roots.groupBy(GROUP).agg(F.min("root").alias("root")).filter("root IS NOT NULL")
    edges = edges.join(roots.select(GROUP), GROUP, "left_semi")
    edges = keep(edges.groupBy(GROUP, "src", "dst").agg(F.min("ord").alias("ord")))
    size = edges.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"))
    large, n_large, _ = cut(size.filter(F.col("n") > max_edges).select(GROUP))
    start = roots.select(GROUP, F.col("root").alias("dst"), F.lit(None).cast(edges.schema["src"].dataType).alias("src"), F.lit(-1).alias("ord"))
    rows = edges.select(GROUP, "src", "dst", "ord").unionByName(start)
    node_type = edges.schema["src"].dataType.simpleString()
    schema = f"{GROUP} {edges.schema[GROUP].dataType.simpleString()}, node {node_type}, parent {node_type}, pre bigint, post bigint"
    small = rows.join(large, GROUP, "left_anti").groupBy(GROUP).applyInPandas(_visit, schema)
    if not n_large:
        return small
    return small.unionByName(_step_by_step(edges.join(large, GROUP, "left_semi"), roots.join(large, GROUP, "left_semi")))


def _visit(rows: pd.DataFrame) -> pd.DataFrame:
    graph = rows[GROUP].iloc[0]
    rows = rows.sort_values(["ord", "dst"])
    inner = rows[rows["src"].notna()]
    children = {src: iter(list(part)) for src, part in inner.groupby("src", sort=False)["dst"]}
    root = rows.loc[rows["src"].isna(), "dst"].iloc[0]
    parent, pre, post, way = {root: None}, {root: 0}, {}, [root]
    while way:
        child = next((c for c in children.get(way[-1], ()) if c not in parent), None)
        if child is None:
            post[way.pop()] = len(post)
        else:
            parent[child] = way[-1]
            pre[child] = len(pre)
            way.append(child)
    nodes = list(pre)
    return pd.DataFrame(
        {GROUP: graph, "node": nodes, "parent": [parent[n] for n in nodes], "pre": [pre[n] for n in nodes], "post": [post[n] for n in nodes]}
    )


def _step_by_step(edges: DataFrame, roots: DataFrame) -> DataFrame:
    node_type = edges.schema["src"].dataType
    none = F.lit(None)
    seen = keep(
        roots.select(
            GROUP, F.col("root").alias("node"), none.cast(node_type).alias("parent"), F.lit(0).cast("bigint").alias("pre"), none.cast("bigint").alias("post")
        )
    )
    while True:
        # the open node touched last is where a graph's visit stands
        here = seen.filter("post IS NULL").groupBy(GROUP).agg(F.max_by("node", "pre").alias("src"))
        count = seen.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n_pre"), F.count("post").alias("n_post"))
        fresh = edges.join(seen.select(GROUP, F.col("node").alias("dst")), [GROUP, "dst"], "left_anti")
        step = here.join(fresh, [GROUP, "src"], "left").groupBy(GROUP, "src").agg(F.min(F.struct("ord", "dst")).alias("to"))
        step, n, _ = cut(step.join(count, GROUP).select(GROUP, "src", F.col("to.dst").alias("dst"), "n_pre", "n_post"))
        if not n:
            return seen
        done = step.filter("dst IS NULL").select(GROUP, F.col("src").alias("node"), F.col("n_post").alias("closed"))
        new = step.filter("dst IS NOT NULL").select(
            GROUP, F.col("dst").alias("node"), F.col("src").alias("parent"), F.col("n_pre").alias("pre"), none.cast("bigint").alias("post")
        )
        old = seen.join(done, [GROUP, "node"], "left").select(GROUP, "node", "parent", "pre", F.coalesce("post", "closed").alias("post"))
        seen = keep(old.unionByName(new))


def dfs_edge_classes(edges: DataFrame, roots: DataFrame, dom: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(func_id, src, dst, edge_class) as a depth-first visit meets the edges: tree, forward, cross, back or retreating."""
    visit = keep(dfs_order(edges, roots, max_edges))
    a = visit.select(GROUP, F.col("node").alias("src"), F.col("pre").alias("a_pre"), F.col("post").alias("a_post"))
    b = visit.select(GROUP, F.col("node").alias("dst"), F.col("parent").alias("up"), F.col("pre").alias("b_pre"), F.col("post").alias("b_post"))
    rows = edges.select(GROUP, "src", "dst").distinct().join(a, [GROUP, "src"]).join(b, [GROUP, "dst"])
    head = tree_of(dom).above(edges.select(GROUP, "src", "dst").distinct(), "dst", "src").withColumn("dominated", F.lit(True))
    rows = rows.join(head, [GROUP, "src", "dst"], "left")
    above = (F.col("b_pre") <= F.col("a_pre")) & (F.col("b_post") >= F.col("a_post"))
    below = (F.col("b_pre") > F.col("a_pre")) & (F.col("b_post") < F.col("a_post"))
    named = F.when(above & F.col("dominated"), "back").when(above, "retreating").when(F.col("up") == F.col("src"), "tree").when(below, "forward").otherwise("cross")
    return rows.select(GROUP, "src", "dst", named.alias("edge_class"))
