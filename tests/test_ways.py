"""Components, dominator trees, pointer jumping, orders and ways past dangers against plain searches, on random and on long graphs."""

import random

import pytest
from conftest import got
from pyspark.sql import functions as F

from tributary.fixpoint import jump
from tributary.operators import cycles, dataflow, dominance, domtree, graph, orders, values, versions


def reached(adj, root, avoid=None):
    seen = {root} - {avoid}
    todo = list(seen)
    while todo:
        for y in adj.get(todo.pop(), ()):
            if y != avoid and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def name(i):
    return f"n{i:03}"


@pytest.fixture(scope="module")
def graphs():
    """Random graphs, some with long ways, some unreachable in part: {func_id: set of edges}."""
    pick, out = random.Random(11), {}
    for g in range(60):
        n = pick.choice([1, 2, 3, 5, 8, 12, 20])
        e = {(pick.randrange(n), pick.randrange(n)) for _ in range(int(n * pick.choice([1, 1.5, 2, 3])))}
        if pick.random() < 0.4:
            e |= {(i, i + 1) for i in range(n - 1)}
        if pick.random() < 0.1:
            e = {(i, i + 1) for i in range(40)} | {(i, max(0, i - pick.randrange(5))) for i in range(0, 40, 3)}
        out[g] = e
    return out


@pytest.fixture(scope="module")
def tables(spark, graphs):
    rows = [(g, name(a), name(b)) for g, e in graphs.items() for a, b in e]
    edges = spark.createDataFrame(rows, "func_id bigint, src string, dst string")
    return edges, edges.select("func_id", F.lit(name(0)).alias("root")).distinct()


@pytest.fixture(scope="module")
def dominated(graphs):
    """{(func_id, node): set of its dominators}."""
    out = {}
    for g, e in graphs.items():
        adj = {}
        for a, b in e:
            adj.setdefault(a, []).append(b)
        seen = reached(adj, 0)
        for d in seen:
            for v in seen - reached(adj, 0, d):
                out.setdefault((g, name(v)), set()).add(name(d))
    return out


@pytest.fixture(scope="module")
def tree(tables):
    return domtree.dominator_tree(*tables)


def test_strong_components(tables, graphs):
    want = set()
    for g, e in graphs.items():
        adj = {}
        for a, b in e:
            adj.setdefault(a, []).append(b)
        ways = {x: reached(adj, x) for pair in e for x in pair}
        for x in ways:
            ring = {y for y in ways[x] if x in ways[y]}
            if len(ring) > 1 or (x, x) in e:
                want.add((g, name(x), name(min(ring))))
    assert got(cycles.strong_components(tables[0]), "func_id", "node", "component") == want


def test_no_cycles(table, edges):
    assert cycles.strong_components(edges("a>b b>c a>c")).count() == 0
    assert cycles.strong_components(table("func_id bigint, src string, dst string", [])).count() == 0
    assert got(cycles.strong_components(edges("a>a a>b")), "node", "component") == {("a", "a")}


def test_dominator_tree_is_the_relation(tree, dominated):
    rows = tree.relation().collect()
    assert {(r.func_id, r.node, r.dom) for r in rows} == {(*k, d) for k, ds in dominated.items() for d in ds} and len(rows) == len({r[:3] for r in rows})
    depth = {(r.func_id, r.node): r.depth for r in tree.nodes.collect()}
    assert depth == {k: len(ds) for k, ds in dominated.items()}
    assert all(r.pos + 1 == depth[r.func_id, r.dom] for r in rows)


def test_common_ancestors(tree, dominated, spark):
    pick, nodes = random.Random(2), sorted(dominated)
    pairs = [(g, a, pick.choice([b for h, b in nodes if h == g])) for g, a in nodes]
    asked = spark.createDataFrame(pairs, "func_id bigint, a string, b string")
    rows = tree.meet(asked, "a", "b").collect()
    assert len(rows) == len(pairs)
    for r in rows:
        both = dominated[r.func_id, r.a] & dominated[r.func_id, r.b]
        assert r.meet == max(both, key=lambda d: len(dominated[r.func_id, d])) and r.meet_depth == len(both)
    assert got(tree.above(asked, "a", "b"), "func_id", "a", "b") == {p for p in pairs if p[1] in dominated[p[0], p[2]]}


def test_several_roots_have_no_common_dominator(table, edges):
    e = edges("a>c b>c c>d")
    tree = domtree.dominator_tree(e, table("func_id bigint, root string", [(1, "a"), (1, "b")]))
    assert got(tree.nodes, "node", "parent", "depth") == {("a", None, 1), ("b", None, 1), ("c", None, 1), ("d", "c", 2)}


def test_sizes_and_nearest_marks(tables, tree, dominated, spark):
    dom = dominance.dominators(*tables)
    want = {}
    for (g, _), ds in dominated.items():
        for d in ds:
            want[g, d] = want.get((g, d), 0) + 1
    assert got(dominance.dom_sizes(dom), "func_id", "head", "n_nodes") == {(*k, n) for k, n in want.items()}
    pick = random.Random(4)
    marks = {(g, v, x) for g, v in dominated for x in "pqr" if pick.random() < 0.3}
    points = {(g, v, x) for g, v in dominated for x in "pqr"}

    def table(rows):
        return spark.createDataFrame(sorted(rows), "func_id bigint, node string, x string")

    def nearest(g, v, x, strict):
        found = [d for d in dominated[g, v] if (g, d, x) in marks and not (strict and d == v)]
        return max(found, key=lambda d: len(dominated[g, d]), default=None)

    at, above = tree.nearest(table(points), table(marks), ["x"])
    assert got(at, "func_id", "node", "x", "at") == {(*p, nearest(*p, False)) for p in points}
    assert got(above, "func_id", "node", "x", "above") == {(*p, nearest(*p, True)) for p in marks}


def test_long_chains_take_few_rows(spark):
    n = 20_000
    chain = spark.range(n).select(F.lit(1).cast("bigint").alias("func_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    loops = spark.range(0, n - 10, 100).select(F.lit(1).cast("bigint").alias("func_id"), (F.col("id") + 7).alias("src"), F.col("id").alias("dst"))
    tree = domtree.dominator_tree(chain.unionByName(loops), spark.createDataFrame([(1, 0)], "func_id bigint, root bigint"))
    assert tree.nodes.filter("coalesce(parent, -1) <> node - 1 OR depth <> node + 1").count() == 0 and tree.nodes.count() == n + 1
    assert sum(level.count() for level in tree.levels) <= 6 * (n + 1)
    asked = spark.createDataFrame([(1, 17, 19_000), (1, 19_999, 3)], "func_id bigint, a bigint, b bigint")
    assert got(tree.meet(asked, "a", "b"), "a", "meet") == {(17, 17), (19_999, 3)}


@pytest.mark.parametrize("length", [1, 2, 3, 7])
def test_walks_end_on_cycles(table, length):
    rows, want = [], {}
    for tail in range(1, 41):
        ring = [f"r{i}" for i in range(length)]
        rows += [(tail, x, ring[(i + 1) % length]) for i, x in enumerate(ring)]
        want |= {(tail, x): ("r0", (length - i) % length) for i, x in enumerate(ring)}
        way = [f"t{i:02}" for i in range(tail)] + [ring[tail % length]]
        rows += [(tail, a, b) for a, b in zip(way, way[1:])]
        for i, x in enumerate(way[:-1]):
            want[tail, x] = ("r0", tail - i + want[tail, way[-1]][1])
    rows += [(99, f"e{i}", f"e{i + 1}") for i in range(70)]
    want |= {(99, f"e{i}"): ("e70", 70 - i) for i in range(70)}
    out = jump(table("func_id bigint, node string, parent string", rows)).collect()
    assert {(r.func_id, r.node): (r.parent, r.steps) for r in out} == want and len(out) == len(want)


def test_places_are_intervals(table):
    pick = random.Random(8)
    parents = [(g, name(i), None if not i or pick.random() < 0.1 else name(pick.randrange(i))) for g in range(20) for i in range(pick.randrange(1, 40))]
    rows = {(r.func_id, r.node): (r.place, r.leave) for r in orders.places(table("func_id bigint, node string, parent string", parents)).collect()}
    up = {(g, n): p for g, n, p in parents}
    assert set(rows) == set(up)
    for (g, a), (lo, hi) in rows.items():
        for (h, b), (x, y) in rows.items():
            if g == h:
                z = b
                while z is not None and z != a:
                    z = up[g, z]
                assert (lo <= x and y <= hi) == (z == a)


def test_levels_and_reduction(table):
    pick, rows = random.Random(6), []
    for g in range(40):
        n = pick.choice([3, 6, 12, 25])
        rows += [(g, name(a), name(b)) for a in range(n) for b in range(a + 1, n) if pick.random() < pick.choice([0.1, 0.3, 0.8])]
    out = graph.reduce_dag(table("func_id bigint, src string, dst string", rows))
    adj = {}
    for g, a, b in rows:
        adj.setdefault(g, {}).setdefault(a, []).append(b)
    want = {(g, a, b) for g, a, b in rows if not any(b in reached(adj[g], c) for c in adj[g][a] if c != b)}
    assert got(out, "func_id", "src", "dst") == want and 0 < len(want) < len(set(rows))
    level = {}
    for g, a, b in sorted(rows):  # sources in order of their numbers, so that each is final when it is used
        level[g, b] = max(level.get((g, b), 0), level.setdefault((g, a), 0) + 1)
    assert {(r.func_id, r.node): r.level for r in graph.levels(table("func_id bigint, src string, dst string", rows)).collect()} == level


def test_reduction_around_a_hub(table):
    rows = [(1, "hub", f"m{i}") for i in range(50)] + [(1, f"m{i}", f"z{i}") for i in range(50)] + [(1, "hub", f"z{i}") for i in range(50)] + [(1, "hub", "own")]
    out = graph.reduce_dag(table("func_id bigint, src string, dst string", rows))
    assert got(out, "src", "dst") == {(a, b) for _, a, b in rows if not (a == "hub" and b[0] == "z")}


def test_ways_past_dangers(tables, graphs, spark):
    pick, pairs, danger = random.Random(9), [], []
    for g, e in graphs.items():
        nodes = sorted({name(x) for pair in e for x in pair})
        pairs += [(g, i, pick.choice(nodes), pick.randrange(1, 5), pick.choice(nodes), pick.randrange(1, 5)) for i in range(12)]
        danger += [(g, pick.choice(nodes), pick.randrange(0, 6)) for _ in range(max(1, len(nodes) // 4))]
    asked = spark.createDataFrame(pairs, "func_id bigint, pair int, def_block string, def_idx int, use_block string, use_idx int")
    found = got(dataflow.unsafe_between(tables[0], asked, spark.createDataFrame(danger, "func_id bigint, block string, idx int")), "func_id", "pair")
    want = set()
    for g, i, d, di, u, ui in pairs:
        adj = {}
        for a, b in graphs[g]:
            adj.setdefault(name(a), []).append(name(b))
        for _, block, at in (x for x in danger if x[0] == g):
            if d == u:
                hit = block == d and di <= at < ui
            elif block == u:
                hit = at < ui
            elif block == d:
                hit = at > di
            else:
                hit = block in reached(adj, d) and u in reached(adj, block)
            if hit:
                want.add((g, i))
    assert found == want and 0 < len(want) < len(pairs)


def test_versions_and_places_of_uses(tables, dominated, spark):
    dom = dominance.dominators(*tables)
    pick = random.Random(5)
    known = sorted({(g, v, pick.choice("xy"), pick.randrange(9)) for g, v in dominated if pick.random() < 0.4})
    points = sorted({(g, v, x) for g, v in dominated for x in "xy"})
    out = versions.nearest_dominating(spark.createDataFrame(points, "func_id bigint, block string, name string"), spark.createDataFrame(known, "func_id bigint, block string, name string, version int"), dom)
    want = set()
    for g, v, x in points:
        best = [(len(dominated[g, d]), n) for h, d, y, n in known if (h, y) == (g, x) and d in dominated[g, v]]
        if best:
            want.add((g, v, x, max(best)[1]))
    assert got(out, "func_id", "block", "name", "version") == want
    uses = sorted({(g, pick.choice("ab"), v, pick.random() < 0.4) for g, v in dominated if pick.random() < 0.5})
    out = values.placement(dom, spark.createDataFrame(uses, "func_id bigint, grp string, node string, in_phi boolean"))
    want = set()
    for g, x in {u[:2] for u in uses}:
        mine = [u for u in uses if u[:2] == (g, x)]
        shared = set.intersection(*(dominated[g, u[2]] for u in mine)) - {u[2] for u in mine if u[3]}
        if shared:
            want.add((g, x, max(shared, key=lambda d: len(dominated[g, d]))))
    assert got(out, "func_id", "grp", "block") == want


def test_labels_follow_the_largest_too(edges, table):
    from tributary.fixpoint import least

    e = edges("a>b b>c c>a d>c")
    start = table("func_id bigint, node string, label string", [(1, "a", "k"), (1, "d", "z"), (1, "b", "m")])
    assert got(least(e, start), "node", "label") == {("a", "k"), ("b", "k"), ("c", "k"), ("d", "z")}
    assert got(least(e, start, largest=True), "node", "label") == {("a", "z"), ("b", "z"), ("c", "z"), ("d", "z")}


def test_shortcuts_over_two_edges_need_no_labels(table, monkeypatch):
    tree = [(0, f"n{(i - 1) // 3}", f"n{i}") for i in range(1, 60)]
    up = {b: a for _, a, b in tree}
    rows = tree + [(0, up[a], b) for _, a, b in tree if a in up]
    monkeypatch.setattr(orders, "WayLabels", None)
    out = graph.reduce_dag(table("func_id bigint, src string, dst string", rows))
    assert got(out, "func_id", "src", "dst") == set(tree)
