"""What is broadcast and shuffled: real sizes, rows dealt out by graph, one grouping instead of two differences."""

import random

import pytest
from conftest import got
from pyspark.sql import functions as F

from tributary import fixpoint
from tributary.operators import domtree, dominance as d
from tributary.operators import graph as g
from tributary.tables import SUBSET, cut, real_sizes

EDGE, ROOT, NODE = "func_id bigint, src string, dst string", "func_id bigint, root string", "func_id bigint, node string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_packed_small_is_not_sent_through_the_driver(spark):
    real_sizes(spark)
    n = 400_000
    rows = spark.range(n).select(F.xxhash64("id").alias("func_id"), F.lit("a step with a long name").alias("src"), (F.col("id") % 10).cast("string").alias("dst"))
    table, stored, _ = cut(rows)
    assert stored == n
    assert "BroadcastHashJoin" not in plan(table.join(table.withColumnRenamed("dst", "far"), ["func_id", "src"]))
    small, _, _ = cut(rows.limit(50))
    assert "BroadcastHashJoin" in plan(table.join(small.withColumnRenamed("dst", "far"), ["func_id", "src"]))


@pytest.fixture(scope="module")
def graphs(table):
    rng = random.Random(5)
    pairs = {(s, str(rng.randrange(9)), str(rng.randrange(9))) for s in range(30) for _ in range(rng.randrange(4, 24))}
    return table(EDGE, sorted(pairs)), table(ROOT, [(s, "0") for s in range(30)])


def test_dealing_by_graph_changes_no_result(graphs, table, spark, monkeypatch):
    edges, roots = graphs
    stop = table(NODE, [(s, "3") for s in range(30)])

    def all_of():
        e = fixpoint.edge_table(edges.select("*"))
        seeds = roots.select("func_id", F.col("root").alias("node"))
        reached = got(fixpoint.propagate(seeds, e, stop=stop, depth="depth"), "func_id", "node", "depth")
        dom = d.dominators(e, roots)
        return e._small_graphs, reached, got(dom, "func_id", "node", "dom", "pos"), got(d.edge_classes(e, dom), "func_id", "src", "dst", "edge_class")

    want = all_of()
    for module in (fixpoint, domtree):
        monkeypatch.setattr(module, "DEAL", 0)
    dealt = all_of()
    assert (want[0], dealt[0]) == (False, True)
    assert dealt[1:] == want[1:]
    assert spark.conf.get(SUBSET) == "true"
    monkeypatch.setattr(fixpoint, "GRAPH", 3)
    assert all_of() == want


def test_graph_diff_is_one_grouping(table):
    a = table(EDGE, [(1, "x", "y"), (1, "x", "y"), (1, None, "y"), (2, "x", None), (3, "p", "q")])
    b = table(EDGE, [(1, "x", "y"), (1, None, "y"), (2, "x", "z"), (2, "x", "z")])
    diff = g.graph_diff(a, b)
    assert plan(diff).count("Exchange hashpartitioning") == 1
    rows = [tuple(r) for r in diff.collect()]
    assert sorted(rows, key=str) == sorted([(2, "x", None, "left"), (3, "p", "q", "left"), (2, "x", "z", "right")], key=str)
