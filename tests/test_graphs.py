"""Graph operators on hand-drawn graphs and against brute force."""

import random

import pytest
from conftest import got
from pyspark.sql import functions as F

from tributary import fixpoint
from tributary.operators import dominance as d
from tributary.operators import graph as g
from tributary.operators import visits

ROOT = "func_id bigint, root string"
NODE = "func_id bigint, node string"

CLASSES = [
    ("0>1 0>3 1>2 2>0 1>3 3>4 2>4", "tree 0>1 1>2 1>3 2>4 forward 0>3 back 2>0 cross 3>4"),
    ("0>1 1>3 2>4 0>2 2>3 3>4 4>2", "tree 0>1 1>3 3>4 4>2 forward 0>2 retreating 2>3 2>4"),
    ("0>1 0>4 1>3 1>2 2>1 3>4 4>1", "tree 0>1 1>3 1>2 3>4 forward 0>4 back 2>1 retreating 4>1"),
]


@pytest.mark.parametrize("text,expected", CLASSES)
@pytest.mark.parametrize("max_edges", [100, 0])
def test_dfs_edge_classes(edges, table, text, expected, max_edges):
    want, kind = set(), None
    for word in expected.split():
        if ">" in word:
            want.add((*word.split(">"), kind))
        else:
            kind = word
    e, roots = edges(text), table(ROOT, [(1, "0")])
    assert got(visits.dfs_edge_classes(e, roots, d.dominators(e, roots), max_edges), "src", "dst", "edge_class") == want


def test_dominators(edges, table):
    e, roots = edges("0>1 1>2 2>4 1>3 3>4 4>1 1>5"), table(ROOT, [(1, "0")])
    dom = d.dominators(e, roots)
    assert got(d.immediate(dom), "node", "idom") == {("1", "0"), ("2", "1"), ("3", "1"), ("4", "1"), ("5", "1")}
    groups = table("func_id bigint, grp string, node string", [(1, "a", "2"), (1, "a", "3"), (1, "a", "4"), (1, "b", "0"), (1, "b", "1")])
    assert got(d.common_dominator(dom, groups), "grp", "dom") == {("a", "1"), ("b", "0")}
    later = d.dominators(edges("0>1 1>2 2>4 1>3 3>4 4>1 1>5 0>4"), roots)
    assert ("4", "1") not in got(later, "node", "dom")


def test_simple_paths(edges, table):
    e = edges("0>1 0>2 0>3 1>4 2>0 2>4")
    paths = g.simple_paths(e, table(NODE, [(1, "0")]), table(NODE, [(1, "4")]))
    assert got(paths.select(F.array_join("path", "").alias("p")), "p") == {"014", "024"}


def test_has_path_besides_the_edge(edges, table):
    e = edges("0>1 1>2 0>2 2>3 3>2")
    pairs = table("func_id bigint, src string, dst string", [(1, "0", "2"), (1, "1", "2"), (1, "0", "9"), (1, "2", "3")])
    assert got(g.has_path(e, pairs, no_edge=True).filter("found"), "src", "dst") == {("0", "2")}
    assert got(g.has_path(e, pairs).filter("found"), "src", "dst") == {("0", "2"), ("1", "2"), ("2", "3")}


def test_back_edges_of_growing_graph(edges, table):
    roots = table(ROOT, [(1, "0")])
    text = "0>1 0>3 1>2 2>0 1>3 3>4 2>4"
    steps = [(" 3>0", {("2", "0"), ("3", "0")}), (" 4>5 5>4", {("2", "0"), ("3", "0"), ("5", "4")}), (" 4>1", {("2", "0"), ("3", "0"), ("5", "4")})]
    for more, want in steps:
        text += more
        e = edges(text)
        classes = d.edge_classes(e, d.dominators(e, roots))
        assert got(classes.filter("edge_class = 'back'"), "src", "dst") == want
    e = edges(text + " 2>5")
    assert got(d.edge_classes(e, d.dominators(e, roots)).filter("edge_class = 'back'"), "src", "dst") == {("2", "0"), ("3", "0")}


def test_loop_entry_is_retreating_if_one_edge_is(edges, table):
    e, roots = edges("0>1 1>3 2>4 0>2 3>4 4>2"), table(ROOT, [(1, "0")])
    loops = d.loop_edges(d.edge_classes(e, d.dominators(e, roots)))
    assert set(got(loops, "head", "kind")) == {("2", "retreating"), ("4", "retreating")}


def test_noreturn_boundary(edges, table):
    e = edges("r>a r>b a>x a>y b>y b>z c>z")
    nodes = table(NODE, [(1, n) for n in "rabcxyz"])
    bad = table(NODE, [(1, "x"), (1, "y")])
    assert got(d.noreturn_boundary(e, nodes, bad), "src", "dst") == {("r", "a"), ("b", "y")}


def test_noreturn_boundary_by_brute_force(table):
    """Graphs with rings and nodes that are named as the virtual ones once were."""
    names = ["<end>", "<no return>", *"abcdefg"]
    rows, nodes, lost, want = [], [], [], set()
    for f in range(20):
        pick = random.Random(f)
        pairs = {(a, b) for i, a in enumerate(names[:6]) for b in pick.sample(names, pick.randrange(3)) if i % 3 or a != b}
        ends = {n for n in names if not any(a == n for a, _ in pairs)}
        bad = set(pick.sample(sorted(ends), len(ends) // 2))
        reach = closure_of(pairs) | {(n, n) for n in names}
        doomed = {n for n in names if any((n, b) in reach for b in bad) and not any((n, g) in reach for g in ends - bad)}
        want |= {(f, a, b) for a, b in pairs if b in doomed and a not in doomed}
        rows += [(f, a, b) for a, b in pairs]
        nodes += [(f, n) for n in names]
        lost += [(f, n) for n in bad]
    found = got(d.noreturn_boundary(table("func_id bigint, src string, dst string", rows), table(NODE, nodes), table(NODE, lost)), "func_id", "src", "dst")
    assert found == want and len(want) >= 10


def random_graph(seed, n=9, m=16):
    rnd = random.Random(seed)
    out = {(str(i), str(rnd.randrange(i, n))) for i in range(n - 1)} | {("0", "1")}
    while len(out) < m:
        out.add((str(rnd.randrange(n)), str(rnd.randrange(n))))
    return sorted(out)


def closure_of(pairs):
    got_ = set(pairs)
    while True:
        more = {(a, z) for a, b in got_ for y, z in pairs if b == y} - got_
        if not more:
            return got_
        got_ |= more


@pytest.fixture(scope="module")
def many(table):
    graphs = {s: random_graph(s) for s in range(25)}
    rows = [(s, a, b) for s, pairs in graphs.items() for a, b in pairs]
    return graphs, table("func_id bigint, src string, dst string", rows)


def test_closure_and_components(many):
    graphs, e = many
    want = {(s, a, b) for s, pairs in graphs.items() for a, b in closure_of(pairs)}
    assert got(g.closure(e), "func_id", "src", "dst") == want
    named = got(g.components(e), "func_id", "node", "component")
    for s, pairs in graphs.items():
        both = closure_of([*pairs, *[(b, a) for a, b in pairs]])
        nodes = {x for p in pairs for x in p}
        assert {(n, c) for f, n, c in named if f == s} == {(n, min({n} | {b for a, b in both if a == n})) for n in nodes}


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_one_or_several_hops_per_job(many, table, small, monkeypatch):
    graphs, e = many
    monkeypatch.setattr(fixpoint, "SMALL", small)
    seeds = table(NODE, [(s, "0") for s in graphs])
    stop = table(NODE, [(s, "3") for s in graphs])
    found = got(fixpoint.propagate(seeds, e, stop=stop, depth="depth"), "func_id", "node", "depth")
    want = set()
    for s, pairs in graphs.items():
        depth, queue = {"0": 0}, ["0"]
        for n in queue:
            for a, b in pairs:
                if a == n and b not in depth and n != "3":
                    depth[b] = depth[n] + 1
                    queue.append(b)
        want |= {(s, n, k) for n, k in depth.items()}
    assert found == want


def test_loop_exits_by_brute_force(many, table):
    graphs, e = many
    roots = table(ROOT, [(s, "0") for s in graphs])
    bodies = d.loop_bodies(d.edge_classes(e, d.dominators(e, roots)))
    start = {}
    for s, h, n in got(bodies, "func_id", "head", "node"):
        start.setdefault((s, h), set()).add(n)
    want = set()
    for (s, h), region in start.items():
        pairs, region = graphs[s], set(region)
        while True:
            after = {b for a, b in pairs if a in region and b not in region}
            taken = {n for n in after if n != "0" and all(a in region for a, b in pairs if b == n)} if len(after) > 1 else set()
            if not taken:
                break
            region |= taken
        want |= {(s, h, n) for n in after}
    assert got(d.loop_exits(e, bodies, roots), "func_id", "head", "node") == want


def test_chains_levels_and_reduction(edges, table):
    e = edges("a>b b>c a>c c>d d>e x>e e>f")
    assert got(g.chains(e), "node", "start", "pos") == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("d", "c", 1), ("x", "x", 0), ("e", "e", 0), ("f", "e", 1)}
    assert got(g.levels(e), "node", "level") == {("a", 0), ("x", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 5)}
    assert got(g.reduce_dag(e), "src", "dst") == {tuple(p) for p in ("ab", "bc", "cd", "de", "xe", "ef")}
    assert got(g.levels(edges("a>b b>a b>c")), "level") == {None}


def test_graph_diff_and_contract(table):
    pairs = table("func_id bigint, a string, b string", [(1, "a", "b"), (1, "b", "c"), (1, "c", "d")])
    groups = table("func_id bigint, grp string, node string", [(1, "g", "a"), (1, "g", "c"), (1, "h", "d")])
    merged, conflicts = g.contract(pairs, groups)
    assert got(merged, "a", "b") == {("a", "b"), ("a", "d")} and not got(conflicts, "a", "b")
    assert got(g.graph_diff(merged, merged), "side") == set()
    assert len(got(g.graph_diff(merged, pairs), "a", "b", "side")) == 3


