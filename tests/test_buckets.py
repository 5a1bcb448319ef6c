"""Small graphs are stored in buckets by graph: rounds need no shuffle, and results are the same."""

import random

from conftest import got
from pyspark.sql import functions as F

from tributary import fixpoint
from tributary.operators import dataflow as f
from tributary.operators import dominance as d
from tributary.operators import graph as g
from tributary.operators import mining, trees
from tributary.operators.cycles import strong_components
from tributary.tables import _as_dealt

EDGE = "func_id bigint, src string, dst string"


def graphs(table):
    rng = random.Random(11)
    pairs = {(s, str(rng.randrange(8)), str(rng.randrange(8))) for s in range(25) for _ in range(rng.randrange(4, 20))}
    return table(EDGE, sorted(pairs)), table("func_id bigint, root string", [(s, "0") for s in range(25)])


def test_rounds_of_small_graphs_are_not_shuffled(table, spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "DEAL", 0)
    edges, roots = graphs(table)
    e = fixpoint.edge_table(edges)
    seen = fixpoint.propagate(roots.select("func_id", F.col("root").alias("node")), e)
    with _as_dealt(spark):
        step = seen.withColumnRenamed("node", "src").join(e, ["func_id", "src"]).groupBy("func_id", "dst").count()
        assert "Exchange" not in step._jdf.queryExecution().executedPlan().toString()


def test_buckets_change_no_result(table, monkeypatch):
    edges, roots = graphs(table)
    rng = random.Random(12)
    pairs = [(s, i, str(rng.randrange(8)), rng.randrange(20), str(rng.randrange(8)), rng.randrange(20)) for s in range(25) for i in range(6)]
    pairs = table("func_id bigint, pair bigint, def_block string, def_idx bigint, use_block string, use_idx bigint", pairs)
    danger = table("func_id bigint, block string, idx bigint", [(s, str(rng.randrange(8)), rng.randrange(20)) for s in range(25) for _ in range(2)])

    def all_of():
        e = fixpoint.edge_table(edges.select("*"))
        dom = d.dominators(e, roots)
        bodies = d.loop_bodies(d.edge_classes(e, dom))
        return (
            got(strong_components(e), "func_id", "node", "component"),
            got(f.unsafe_between(e, pairs, danger), "func_id", "pair"),
            got(bodies, "func_id", "head", "node"),
            got(d.irregular_loops(e, bodies), "func_id", "head", "n_nodes", "n_entries", "n_exits"),
            got(d.loop_exits(e, bodies, roots), "func_id", "head", "node"),
            got(d.regions(e, dom), "func_id", "head", "n_nodes"),
            got(g.has_path(e, e, no_edge=True), "func_id", "src", "dst", "found"),
        )

    want = all_of()
    monkeypatch.setattr(fixpoint, "DEAL", 0)
    assert all_of() == want


def test_trees_and_jumps_in_buckets(table, monkeypatch):
    nodes = [(s, "r", None, 0, "plus", None) for s in range(9)]
    nodes += [(s, f"{i}", "r", i, None if i else "minus", None if i == 0 else f"v{i}") for s in range(9) for i in range(s % 3 + 2)]
    nodes += [(s, "x", "0", 0, None, "v1") for s in range(9)]
    nodes = table("func_id bigint, node string, parent string, pos int, op string, var string", nodes)
    edges, roots = graphs(table)

    def all_of():
        done = trees.complexity(nodes)
        e = fixpoint.edge_table(edges.select("*"))
        sizes = d.dom_sizes(d.dominators(e, roots))
        return getattr(done, "_dealt", 0), got(done, "func_id", "node", "complexity"), got(trees.dependency_scores(nodes), "func_id", "root", "var", "score"), got(sizes, "func_id", "head", "n_nodes"), got(g.levels(e), "func_id", "node", "level")

    want = all_of()
    monkeypatch.setattr(fixpoint, "DEAL", 0)
    dealt = all_of()
    assert (want[0], dealt[0] > 0) == (0, True)
    assert dealt[1:] == want[1:]


def test_greedy_choice_in_buckets(table, monkeypatch):
    """Small functions are dealt out, also where their parts are not; the choice is the same."""
    rng = random.Random(14)
    rows = [(f, None if fp == 9 else f"e{fp}", idx, rng.randrange(1, 4), fp + 1, None, fp == 5) for f in (1, 2, None) for idx in range(6) for fp in rng.sample(range(10), 6)]
    parts = [(f, f"e{a}", f"e{b}", rng.randrange(1, 3)) for f in (1, 2, None) for a in range(9) for b in rng.sample(range(a + 1), min(a, 2))]
    uses = lambda: table("func_id bigint, fp string, idx int, n int, complexity int, text string, barred boolean", rows)
    parts = table("func_id bigint, fp string, part string, n int", parts)
    plain = mining.common_expr_greedy(uses(), parts)
    want = sorted(map(str, plain.collect()))
    monkeypatch.setattr(fixpoint, "DEAL", 0)
    out = mining.common_expr_greedy(uses(), parts)
    assert sorted(map(str, out.collect())) == want and len(want) > 8
    assert out._dealt
    monkeypatch.setattr(fixpoint, "GRAPH", 40)
    more = parts.unionByName(table("func_id bigint, fp string, part string, n int", [(3, f"x{i}", "y", 1) for i in range(50)]))
    assert sorted(map(str, mining.common_expr_greedy(uses(), more).collect())) == want
