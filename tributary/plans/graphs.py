"""Graph queries over the step graphs of visitors, the link graph of pages and the customer hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import dominance as d
from tributary.operators import graph as g
from tributary.operators import visits
from tributary.plans.registry import query, view

view("flow_reach", """SELECT func_id, root AS node FROM flow_roots UNION
    SELECT e.func_id, e.dst FROM flow_reach r JOIN flow_edges e ON e.func_id = r.func_id AND e.src = r.node""")
view("flow_avoid", """SELECT r.func_id, n.node AS d, r.root AS node FROM flow_roots r JOIN flow_reach n USING (func_id) WHERE n.node <> r.root
    UNION SELECT e.func_id, a.d, e.dst FROM flow_avoid a JOIN flow_edges e ON e.func_id = a.func_id AND e.src = a.node WHERE e.dst <> a.d""")
view("flow_dom", """SELECT n.func_id, n.node, m.node AS dom FROM flow_reach n JOIN flow_reach m USING (func_id)
    ANTI JOIN flow_avoid a ON a.func_id = n.func_id AND a.node = n.node AND a.d = m.node""")
view("flow_depth", "SELECT func_id, node, count(*) AS depth FROM flow_dom GROUP BY ALL")
view("flow_idom", """SELECT p.func_id, p.node, arg_max(p.dom, q.depth) AS idom FROM flow_dom p JOIN flow_depth q
    ON q.func_id = p.func_id AND q.node = p.dom WHERE p.node <> p.dom GROUP BY ALL""")
view("flow_closure", """SELECT func_id, src, dst FROM flow_edges UNION
    SELECT c.func_id, c.src, e.dst FROM flow_closure c JOIN flow_edges e ON e.func_id = c.func_id AND e.src = c.dst""")
view("flow_front", "SELECT e.* FROM flow_edges e ANTI JOIN flow_dom m ON m.func_id = e.func_id AND m.node = e.src AND m.dom = e.dst")
view("flow_front_closure", """SELECT func_id, src, dst FROM flow_front UNION
    SELECT c.func_id, c.src, e.dst FROM flow_front_closure c JOIN flow_front e ON e.func_id = c.func_id AND e.src = c.dst""")
view("flow_classes", """SELECT e.func_id, e.src, e.dst, CASE WHEN f.func_id IS NULL THEN 'back' WHEN c.func_id IS NOT NULL THEN 'irreducible'
    ELSE 'acyclic' END AS edge_class FROM flow_edges e LEFT JOIN flow_front f USING (func_id, src, dst)
    LEFT JOIN flow_front_closure c ON c.func_id = f.func_id AND c.src = f.dst AND c.dst = f.src""")
view("loop_ahead", """SELECT DISTINCT func_id, dst AS head, dst AS node FROM flow_classes WHERE edge_class <> 'acyclic' UNION
    SELECT a.func_id, a.head, e.dst FROM loop_ahead a JOIN flow_classes e ON e.func_id = a.func_id AND e.src = a.node
    WHERE e.edge_class = 'acyclic'""")
view("loop_behind", """SELECT func_id, dst AS head, src AS node FROM flow_classes WHERE edge_class <> 'acyclic' UNION
    SELECT b.func_id, b.head, e.src FROM loop_behind b JOIN flow_classes e ON e.func_id = b.func_id AND e.dst = b.node
    WHERE e.edge_class = 'acyclic'""")
view("loop_body", """SELECT func_id, head, node FROM loop_ahead INTERSECT SELECT func_id, head, node FROM loop_behind UNION
    SELECT func_id, dst, dst FROM flow_classes WHERE edge_class <> 'acyclic'""")
view("loop_after", """SELECT DISTINCT b.func_id, b.head, e.dst AS node FROM loop_body b JOIN flow_edges e ON e.func_id = b.func_id
    AND e.src = b.node ANTI JOIN loop_body i ON i.func_id = b.func_id AND i.head = b.head AND i.node = e.dst""")


def _at(df, column):
    return df.select("func_id", F.col(column).alias("node"))


def _sources(t):
    return _at(t.flow_roots, "root")


def _dom(t):
    return d.dominators(t.flow_edges, t.flow_roots)


def _classes(t):
    return d.edge_classes(t.flow_edges, _dom(t))


@query("reach", """w AS (SELECT func_id, root AS node, 0 AS depth FROM flow_roots UNION SELECT e.func_id, e.dst, w.depth + 1
    FROM w JOIN flow_edges e ON e.func_id = w.func_id AND e.src = w.node WHERE w.depth < 60)
    SELECT func_id, node, min(depth) AS depth FROM w GROUP BY ALL""")
def reach(t):
    return g.reach(t.flow_edges, _sources(t))


@query("ancestors", """a AS (SELECT func_id, block AS node FROM flow_blocks WHERE block LIKE 'purchase%' UNION
    SELECT e.func_id, e.src FROM a JOIN flow_edges e ON e.func_id = a.func_id AND e.dst = a.node) SELECT func_id, node FROM a""")
def ancestors(t):
    return g.ancestors(t.flow_edges, _at(t.flow_blocks, "block").filter("node LIKE 'purchase%'")).drop("depth")


@query("unreachable", """w AS (SELECT func_id, block AS node FROM flow_blocks WHERE block LIKE 'signup%' UNION
    SELECT e.func_id, e.dst FROM w JOIN flow_edges e ON e.func_id = w.func_id AND e.src = w.node)
    SELECT func_id, block AS node FROM flow_blocks EXCEPT SELECT func_id, node FROM w""")
def unreachable(t):
    """Blocks that no sign-up leads to."""
    nodes = _at(t.flow_blocks, "block")
    return g.unreachable(t.flow_edges, nodes.filter("node LIKE 'signup%'").withColumnRenamed("node", "root").select("func_id", F.col("root").alias("node")), nodes)


@query("has_path", """pairs AS (SELECT r.func_id, b.block AS src, r.root AS dst FROM flow_roots r JOIN flow_blocks b USING (func_id) UNION
      SELECT func_id, root, 'purchase#0' FROM flow_roots UNION SELECT func_id, 'purchase#0', 'purchase#0' FROM flow_roots)
    SELECT p.func_id, p.src, p.dst, n.func_id IS NOT NULL OR c.func_id IS NOT NULL AS found FROM pairs p LEFT JOIN flow_closure c USING (func_id, src, dst)
    LEFT JOIN flow_blocks n ON p.src = p.dst AND n.func_id = p.func_id AND n.block = p.src""")
def has_path(t):
    """From which blocks a visitor comes back to the first one, and whether the first one leads to a certain purchase, which many weeks do not have."""
    first, end = F.col("root"), F.lit("purchase#0")
    back = t.flow_blocks.join(t.flow_roots, "func_id").select("func_id", F.col("block").alias("src"), first.alias("dst"))
    pairs = back.unionByName(t.flow_roots.select("func_id", first.alias("src"), end.alias("dst")))
    pairs = pairs.unionByName(t.flow_roots.select("func_id", end.alias("src"), end.alias("dst")))
    return g.has_path(t.flow_edges, pairs, nodes=t.flow_blocks.select("func_id", F.col("block").alias("node")))


@query("has_detour", """w AS (SELECT p.func_id, p.src AS a, p.dst AS b, e.dst AS node FROM flow_edges p JOIN flow_edges e
      ON e.func_id = p.func_id AND e.src = p.src WHERE p.src <> p.dst AND e.dst <> p.src AND e.dst <> p.dst UNION
    SELECT w.func_id, w.a, w.b, e.dst FROM w JOIN flow_edges e ON e.func_id = w.func_id AND e.src = w.node
      WHERE w.node <> w.a AND w.node <> w.b)
    SELECT p.func_id, p.src, p.dst, EXISTS (SELECT 1 FROM w WHERE w.func_id = p.func_id AND w.a = p.src AND w.b = p.dst AND w.node = p.dst) AS found
    FROM flow_edges p WHERE p.src <> p.dst""")
def has_detour(t):
    """Which steps could also be made by way of other blocks."""
    return g.has_path(t.flow_edges, t.flow_edges.filter("src <> dst"), no_edge=True)


@query("shortest_path", """w AS (SELECT func_id, root AS node, [root] AS path FROM flow_roots UNION ALL
    SELECT e.func_id, e.dst, min(list_append(w.path, e.dst)) FROM w JOIN flow_edges e ON e.func_id = w.func_id AND e.src = w.node
    WHERE NOT list_contains(w.path, e.dst) AND len(w.path) < 40 GROUP BY e.func_id, e.dst)
    SELECT func_id, node, array_to_string(path, '>') AS path FROM (SELECT func_id, node, arg_min(path, (len(path), path)) AS path
    FROM w GROUP BY ALL)""")
def shortest_path(t):
    return g.shortest_paths(t.flow_edges, _sources(t)).select("func_id", "node", F.array_join("path", ">").alias("path"))


@query("simple_paths", """w AS (SELECT DISTINCT func_id, src AS node, [src] AS path FROM hier_edges WHERE src LIKE 'r:%' UNION ALL
    SELECT e.func_id, e.dst, list_append(w.path, e.dst) FROM w JOIN (SELECT DISTINCT * FROM hier_edges) e
      ON e.func_id = w.func_id AND e.src = w.node WHERE NOT list_contains(w.path, e.dst))
    SELECT func_id, array_to_string(path, '>') AS path FROM w WHERE node LIKE 'o:%'""")
def simple_paths(t):
    edges = t.hier_edges
    sources = _at(edges, "src").filter("node LIKE 'r:%'").distinct()
    targets = _at(edges, "dst").filter("node LIKE 'o:%'").distinct()
    return g.simple_paths(edges, sources, targets).select("func_id", F.array_join("path", ">").alias("path"))


@query("topological_levels", """w AS (SELECT func_id, src AS node, 0 AS level FROM hier_edges WHERE src NOT IN (SELECT dst FROM hier_edges) UNION
    SELECT e.func_id, e.dst, w.level + 1 FROM w JOIN hier_edges e ON e.src = w.node)
    SELECT func_id, node, max(level) AS level FROM w GROUP BY ALL""")
def topological_levels(t):
    return g.levels(t.hier_edges)


@query("is_acyclic", """SELECT func_id, NOT bool_or(src = dst) AS acyclic FROM flow_closure GROUP BY ALL""")
def is_acyclic(t):
    return g.is_acyclic(t.flow_edges)


@query("closure", "SELECT func_id, src, dst FROM flow_closure")
def closure(t):
    return g.closure(t.flow_edges)


view("dag", """SELECT func_id, src, dst FROM hier_edges UNION SELECT a.func_id, a.src, b.dst FROM hier_edges a JOIN hier_edges b ON b.src = a.dst""")


@query("reduce_dag", """c AS (SELECT func_id, src, dst FROM dag UNION SELECT c.func_id, c.src, e.dst FROM c JOIN dag e ON e.src = c.dst)
    SELECT func_id, src, dst FROM dag EXCEPT SELECT e.func_id, e.src, c.dst FROM dag e JOIN c ON c.src = e.dst""")
def reduce_dag(t):
    """The hierarchy back from itself with all its two-step shortcuts."""
    edges = t.hier_edges
    second = edges.select("func_id", F.col("src").alias("mid"), F.col("dst"))
    short = edges.select("func_id", "src", F.col("dst").alias("mid")).join(second, ["func_id", "mid"]).select("func_id", "src", "dst")
    return g.reduce_dag(edges.unionByName(short))


view("doc_both", "SELECT src, dst FROM doc_lines UNION SELECT dst, src FROM doc_lines")


@query("components", """w(node, component) USING KEY (node) AS (SELECT src, src FROM doc_both GROUP BY src UNION
    SELECT b.dst, min(w.component) FROM w JOIN doc_both b ON b.src = w.node JOIN recurring.w r ON r.node = b.dst
    WHERE w.component < r.component GROUP BY b.dst)
    SELECT CAST(0 AS BIGINT) AS func_id, node, component FROM w""")
def components(t):
    """Documents that hang together by shared lines."""
    return g.components(t.doc_lines)


@query("degrees", """n AS (SELECT DISTINCT func_id, src, dst FROM page_links), e AS (SELECT func_id, src AS node, 0 AS i, 1 AS o FROM n UNION ALL
    SELECT func_id, dst, 1, 0 FROM n) SELECT func_id, node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, sum(i) = 0 AS is_root, sum(o) = 0 AS is_leaf,
    sum(i) > 1 OR sum(o) > 1 AS is_cross FROM e GROUP BY ALL""")
def degrees(t):
    return g.degrees(t.page_links)


@query("dominators", "SELECT func_id, node, dom FROM flow_dom")
def dominators(t):
    return _dom(t).drop("pos")


@query("immediate_dominator", "SELECT func_id, node, idom FROM flow_idom")
def immediate_dominator(t):
    return d.immediate(_dom(t))


@query("common_dominator", """grp AS (SELECT DISTINCT func_id, use_var AS grp, block AS node FROM flow_instr),
    c AS (SELECT g.func_id, g.grp, m.dom, count(*) AS n FROM grp g JOIN flow_dom m USING (func_id, node) GROUP BY ALL),
    s AS (SELECT func_id, grp, count(*) AS n FROM grp GROUP BY ALL)
    SELECT c.func_id, c.grp, arg_max(c.dom, p.depth) AS dom FROM c JOIN s USING (func_id, grp, n)
    JOIN flow_depth p ON p.func_id = c.func_id AND p.node = c.dom GROUP BY ALL""")
def common_dominator(t):
    """Per variable the nearest block that every use has behind it."""
    return d.common_dominator(_dom(t), t.flow_instr.select("func_id", F.col("use_var").alias("grp"), F.col("block").alias("node")))


@query("dom_children", "SELECT func_id, idom AS node, node AS child FROM flow_idom")
def dom_children(t):
    return d.dom_children(_dom(t))


@query("dom_region_size", "SELECT func_id, dom AS head, count(*) AS n_nodes FROM flow_dom GROUP BY ALL")
def dom_region_size(t):
    return d.dom_sizes(_dom(t))


@query("edge_classes", "SELECT func_id, src, dst, edge_class FROM flow_classes")
def edge_classes(t):
    return _classes(t)


@query("loop_edges", """SELECT func_id, dst AS head, count(*) AS n_edges, CASE WHEN bool_or(edge_class = 'irreducible') THEN 'retreating'
    ELSE 'back' END AS kind FROM flow_classes WHERE edge_class <> 'acyclic' GROUP BY ALL""")
def loop_edges(t):
    return d.loop_edges(_classes(t))


@query("loop_bodies", "SELECT func_id, head, node FROM loop_body")
def loop_bodies(t):
    return d.loop_bodies(_classes(t))


@query("loop_exits", """es AS (SELECT func_id, list({'s': src, 'd': dst}) AS es FROM flow_edges GROUP BY func_id),
    w AS (SELECT func_id, head, 0 AS round, list(node) AS region, true AS more FROM loop_body GROUP BY func_id, head UNION ALL
      SELECT func_id, head, round + 1, list_concat(region, taken), len(taken) > 0 FROM
      (SELECT *, CASE WHEN len(later) > 1 THEN list_filter(later, lambda n: n <> root AND len(list_filter(es, lambda e: e.d = n AND NOT list_contains(region, e.s))) = 0)
        ELSE [] END AS taken FROM
      (SELECT w.func_id, w.head, w.round, w.region, es.es, r.root, list_distinct(list_transform(list_filter(es.es,
          lambda e: list_contains(w.region, e.s) AND NOT list_contains(w.region, e.d)), lambda e: e.d)) AS later
        FROM w JOIN es ON es.func_id = w.func_id JOIN flow_roots r ON r.func_id = w.func_id WHERE w.more))),
    z AS (SELECT func_id, head, arg_max(region, round) AS region FROM w GROUP BY func_id, head)
    SELECT DISTINCT z.func_id, z.head, e.dst AS node FROM z JOIN flow_edges e
      ON e.func_id = z.func_id AND list_contains(z.region, e.src) AND NOT list_contains(z.region, e.dst)""")
def loop_exits(t):
    return d.loop_exits(t.flow_edges, d.loop_bodies(_classes(t)), t.flow_roots)


@query("graph_slice", """f AS (SELECT * FROM flow_reach), b AS (SELECT func_id, block AS node FROM flow_blocks WHERE block LIKE 'purchase%' UNION
    SELECT e.func_id, e.src FROM b JOIN flow_edges e ON e.func_id = b.func_id AND e.dst = b.node),
    n AS (SELECT * FROM f INTERSECT SELECT * FROM b)
    SELECT e.* FROM flow_edges e JOIN n a ON a.func_id = e.func_id AND a.node = e.src JOIN n c ON c.func_id = e.func_id AND c.node = e.dst""")
def graph_slice(t):
    """All steps on ways from the start to a purchase."""
    return g.graph_slice(t.flow_edges, _sources(t), _at(t.flow_blocks, "block").filter("node LIKE 'purchase%'"))


@query("region_sinks", """SELECT DISTINCT b.func_id, b.head, b.node FROM loop_body b LEFT JOIN flow_edges e ON e.func_id = b.func_id AND e.src = b.node
    LEFT JOIN loop_body i ON i.func_id = b.func_id AND i.head = b.head AND i.node = e.dst WHERE i.node IS NULL""")
def region_sinks(t):
    return d.region_sinks(t.flow_edges, d.loop_bodies(_classes(t)))


view("region_size", "SELECT func_id, dom AS head, count(*) AS n_nodes FROM flow_dom GROUP BY ALL")
view("region_out", """SELECT DISTINCT m.func_id, m.dom AS head, m.node, e.dst FROM flow_dom m JOIN flow_edges e ON e.func_id = m.func_id
    AND e.src = m.node ANTI JOIN flow_dom i ON i.func_id = m.func_id AND i.dom = m.dom AND i.node = e.dst""")


@query("regions", """s AS (SELECT r.* FROM region_size r JOIN (SELECT func_id, count(*) AS total FROM flow_reach GROUP BY ALL) USING (func_id)
      WHERE (total >= 3 AND n_nodes >= 3) OR (total = 2 AND n_nodes = 2)),
    o AS (SELECT func_id, head, count(DISTINCT node) AS exits, count(DISTINCT dst) AS targets, min(dst) AS succ FROM region_out GROUP BY ALL),
    star AS (SELECT func_id, src, dst FROM flow_closure UNION SELECT func_id, node, node FROM flow_reach),
    sl AS (SELECT s.func_id, s.head, o.succ, s.n_nodes, a.dst AS node FROM s JOIN o USING (func_id, head) JOIN star a ON a.func_id = s.func_id
      AND a.src = s.head JOIN star b ON b.func_id = s.func_id AND b.src = a.dst AND b.dst = o.succ WHERE o.targets = 1 AND o.exits > 1)
    SELECT s.func_id, s.head, s.n_nodes FROM s LEFT JOIN o USING (func_id, head) WHERE coalesce(exits, 0) <= 1 UNION
    SELECT sl.func_id, sl.head, sl.n_nodes FROM sl LEFT JOIN flow_dom m ON m.func_id = sl.func_id AND m.dom = sl.head AND m.node = sl.node
    GROUP BY ALL HAVING count(m.node) = sl.n_nodes AND count(*) FILTER (WHERE m.node IS NULL AND sl.node <> sl.succ) = 0""")
def regions(t):
    return d.regions(t.flow_edges, _dom(t))


@query("irregular_loops", """z AS (SELECT func_id, head, count(*) AS n_nodes FROM loop_body GROUP BY ALL),
    en AS (SELECT b.func_id, b.head, count(DISTINCT b.node) AS n_entries FROM loop_body b JOIN flow_edges e ON e.func_id = b.func_id AND e.dst = b.node
      ANTI JOIN loop_body i ON i.func_id = b.func_id AND i.head = b.head AND i.node = e.src WHERE b.node <> b.head GROUP BY ALL),
    ex AS (SELECT func_id, head, count(*) AS n_exits FROM loop_after GROUP BY ALL)
    SELECT func_id, head, n_nodes, coalesce(n_entries, 0) AS n_entries, coalesce(n_exits, 0) AS n_exits
    FROM z LEFT JOIN en USING (func_id, head) LEFT JOIN ex USING (func_id, head)""")
def irregular_loops(t):
    return d.irregular_loops(t.flow_edges, d.loop_bodies(_classes(t)))


@query("collapse", """SELECT func_id, split_part(src, '#', 1) AS src, split_part(dst, '#', 1) AS dst, count(*) AS n FROM flow_edges
    WHERE split_part(src, '#', 1) <> split_part(dst, '#', 1) GROUP BY ALL""")
def collapse(t):
    """Blocks of one event type as one node."""
    mapping = t.flow_blocks.select("func_id", F.col("block").alias("node"), F.substring_index("block", "#", 1).alias("region"))
    return g.collapse(t.flow_edges, mapping)


@query("chains", """e AS (SELECT DISTINCT * FROM hier_edges), links AS (SELECT * FROM e WHERE src IN (SELECT src FROM e GROUP BY src HAVING count(*) = 1)
      AND dst IN (SELECT dst FROM e GROUP BY dst HAVING count(*) = 1)), n AS (SELECT func_id, src AS node FROM e UNION SELECT func_id, dst FROM e),
    w AS (SELECT func_id, node, node AS start, 0 AS pos FROM n WHERE node NOT IN (SELECT dst FROM links) UNION ALL
      SELECT l.func_id, l.dst, w.start, w.pos + 1 FROM w JOIN links l ON l.src = w.node) SELECT func_id, node, start, pos FROM w""")
def chains(t):
    return g.chains(t.hier_edges)


@query("noreturn_boundary", """n AS (SELECT src AS node FROM hier_edges UNION SELECT dst FROM hier_edges),
    leaf AS (SELECT node, node IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderstatus = 'F') AS lost FROM n WHERE node NOT IN (SELECT src FROM hier_edges)),
    ok AS (SELECT node FROM leaf WHERE NOT lost UNION SELECT c.src FROM ok JOIN hier_edges c ON c.dst = ok.node),
    bad AS (SELECT node FROM leaf WHERE lost UNION SELECT c.src FROM bad JOIN hier_edges c ON c.dst = bad.node),
    doomed AS (SELECT * FROM bad EXCEPT SELECT * FROM ok)
    SELECT func_id, src, dst FROM hier_edges WHERE dst IN (SELECT node FROM doomed) AND src NOT IN (SELECT node FROM doomed)""")
def noreturn_boundary(t):
    """Steps down the hierarchy after which there are only filled orders."""
    nodes = g.nodes_of(t.hier_edges)
    filled = t.orders.filter("o_orderstatus = 'F'").select(F.lit(0).cast("bigint").alias("func_id"), F.concat(F.lit("o:"), "o_orderkey").alias("node"))
    return d.noreturn_boundary(t.hier_edges, nodes, filled)


@query("graph_equality", """a AS (SELECT func_id, src, dst FROM flow_edges), b AS (SELECT func_id, dst AS src, src AS dst FROM flow_edges)
    SELECT func_id, src, dst, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
    SELECT func_id, src, dst, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def graph_equality(t):
    """What keeps a week's graph from being equal to its reverse."""
    return g.graph_diff(t.flow_edges, g.flipped(t.flow_edges))


@query("induced_subgraph", "SELECT func_id, src, dst FROM flow_edges WHERE src NOT LIKE 'error%' AND dst NOT LIKE 'error%'")
def induced_subgraph(t):
    return g.induced(t.flow_edges, _at(t.flow_blocks, "block").filter("node NOT LIKE 'error%'"))


@query("symmetric_difference", """a AS (SELECT DISTINCT func_id, block FROM flow_instr WHERE form = 'address'),
    b AS (SELECT DISTINCT func_id, block FROM flow_instr WHERE form = 'copy')
    SELECT * FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def symmetric_difference(t):
    """Blocks that take an address or make a copy, but not both."""
    rows = t.flow_instr.select("func_id", "block", "form")
    return g.graph_diff(rows.filter("form = 'address'").drop("form"), rows.filter("form = 'copy'").drop("form")).drop("side")


@query("contract", """p AS (SELECT DISTINCT func_id, least(src, dst) AS a, greatest(src, dst) AS b FROM flow_edges WHERE src <> dst),
    f AS (SELECT func_id, split_part(block, '#', 1) AS grp, min(block) AS first FROM flow_blocks GROUP BY ALL),
    m AS (SELECT b.func_id, b.block AS node, f.first FROM flow_blocks b JOIN f ON f.func_id = b.func_id AND f.grp = split_part(b.block, '#', 1)),
    q AS (SELECT p.func_id, p.a, p.b, x.first AS x, y.first AS y FROM p JOIN m x ON x.func_id = p.func_id AND x.node = p.a
      JOIN m y ON y.func_id = p.func_id AND y.node = p.b)
    SELECT DISTINCT func_id, least(x, y) AS a, greatest(x, y) AS b, false AS conflict FROM q WHERE x <> y UNION ALL
    SELECT func_id, a, b, true FROM q WHERE x = y""")
def contract(t):
    pairs = t.flow_edges.filter("src <> dst").select("func_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    groups = t.flow_blocks.select("func_id", F.substring_index("block", "#", 1).alias("grp"), F.col("block").alias("node"))
    merged, conflicts = g.contract(pairs, groups)
    return merged.withColumn("conflict", F.lit(False)).unionByName(conflicts.withColumn("conflict", F.lit(True)))


view("dfs_adj", "SELECT func_id, src, list(dst ORDER BY first, dst) AS next FROM (SELECT func_id, src, dst, min(idx) AS first FROM flow_steps GROUP BY ALL) GROUP BY ALL")
view("dfs", """SELECT func_id, [root] AS way, [root] AS seen, root AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS pre, CAST(NULL AS BIGINT) AS post, 0 AS n_post
    FROM flow_roots UNION ALL SELECT func_id, CASE WHEN nxt IS NULL THEN way[:-2] ELSE list_append(way, nxt) END, CASE WHEN nxt IS NULL THEN seen ELSE list_append(seen, nxt) END,
      coalesce(nxt, way[-1]), CASE WHEN nxt IS NOT NULL THEN way[-1] END, CASE WHEN nxt IS NOT NULL THEN len(seen) END, CASE WHEN nxt IS NULL THEN n_post END,
      CASE WHEN nxt IS NULL THEN n_post + 1 ELSE n_post END FROM
    (SELECT d.*, list_filter(a.next, lambda c: NOT list_contains(d.seen, c))[1] AS nxt FROM dfs d LEFT JOIN dfs_adj a ON a.func_id = d.func_id AND a.src = d.way[-1]
      WHERE len(d.way) > 0)""")
view("dfs_done", "SELECT func_id, node, max(parent) AS parent, max(pre) AS pre, max(post) AS post FROM dfs GROUP BY ALL")


def _first_steps(t):
    return t.flow_steps.groupBy("func_id", "src", "dst").agg(F.min("idx").alias("ord"))


@query("dfs_order", "SELECT func_id, node, parent, pre, post FROM dfs_done")
def dfs_order(t):
    """Blocks in the order of a depth-first visit that tries steps in the order of the log."""
    return visits.dfs_order(_first_steps(t), t.flow_roots)


@query("dfs_edge_classes", """SELECT e.func_id, e.src, e.dst, CASE WHEN b.pre <= a.pre AND b.post >= a.post THEN CASE WHEN m.node IS NULL THEN 'retreating' ELSE 'back' END
      WHEN b.parent = e.src THEN 'tree' WHEN b.pre > a.pre AND b.post < a.post THEN 'forward' ELSE 'cross' END AS edge_class
    FROM flow_edges e JOIN dfs_done a ON a.func_id = e.func_id AND a.node = e.src JOIN dfs_done b ON b.func_id = e.func_id AND b.node = e.dst
    LEFT JOIN flow_dom m ON m.func_id = e.func_id AND m.node = e.src AND m.dom = e.dst""")
def dfs_edge_classes(t):
    return visits.dfs_edge_classes(_first_steps(t), t.flow_roots, _dom(t))
