"""Queries about equal values: copies, types, reuse, grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import dominance as d
from tributary.operators import values as v
from tributary.plans.registry import query, view


@query("propagate_copies", """w AS (SELECT func_id, dst AS var, src AS origin, 1 AS steps FROM ssa_copies UNION ALL
    SELECT w.func_id, w.var, c.src, w.steps + 1 FROM w JOIN ssa_copies c ON c.func_id = w.func_id AND c.dst = w.origin)
    SELECT func_id, var, arg_max(origin, steps) AS origin, max(steps) AS steps FROM w GROUP BY ALL""")
def propagate_copies(t):
    return v.propagate_copies(t.ssa_copies)


@query("used_once", "SELECT func_id, var FROM ssa_uses GROUP BY ALL HAVING count(*) = 1")
def used_once(t):
    return v.used_once(t.ssa_uses.withColumn("n", F.lit(1)))


view("unsafe_pair", """SELECT DISTINCT p.func_id, p.pair FROM pair p JOIN (SELECT func_id, block, idx FROM flow_instr WHERE kind = 'relation') g
    ON g.func_id = p.func_id AND CASE WHEN p.def_block = p.use_block
      THEN g.block = p.def_block AND g.idx >= p.def_idx AND g.idx < p.use_idx WHEN g.block = p.use_block THEN g.idx < p.use_idx
      WHEN g.block = p.def_block THEN g.idx > p.def_idx ELSE EXISTS (SELECT 1 FROM flow_star a JOIN flow_star b ON b.func_id = a.func_id
        AND b.src = a.dst WHERE a.func_id = p.func_id AND a.src = p.def_block AND a.dst = g.block AND b.dst = p.use_block) END""")
view("flow_star", "SELECT func_id, src, dst FROM flow_closure UNION SELECT func_id, block, block FROM flow_blocks")


@query("propagate_memory", """once AS (SELECT func_id, var FROM ssa_uses GROUP BY ALL HAVING count(*) = 1),
    link AS (SELECT p.func_id, p.use_idx AS idx, p.def_idx FROM pair p JOIN ssa_defs s ON s.func_id = p.func_id AND s.idx = p.def_idx
      LEFT JOIN once o ON o.func_id = s.func_id AND o.var = s.var LEFT JOIN unsafe_pair x ON x.func_id = p.func_id AND x.pair = p.use_idx
      WHERE (CASE WHEN s.kind = 'call' THEN o.var IS NOT NULL ELSE s.kind = 'assignment' AND s.form IN ('copy', 'constant') END)
        AND NOT (s.aliased AND x.pair IS NOT NULL)),
    w AS (SELECT func_id, idx, def_idx AS origin, 1 AS steps FROM link UNION ALL SELECT w.func_id, w.idx, l.def_idx, w.steps + 1
      FROM w JOIN link l ON l.func_id = w.func_id AND l.idx = w.origin)
    SELECT func_id, idx, arg_max(origin, steps) AS origin, max(steps) AS steps FROM w GROUP BY ALL""")
def propagate_memory(t):
    """How far back a row's value comes from: copies and constants, calls used once, aliased ones only without a relation between."""
    once = v.used_once(t.ssa_uses.withColumn("n", F.lit(1))).withColumn("once", F.lit(True))
    defs = t.ssa_defs.join(once, ["func_id", "var"], "left")
    fit = F.when(F.col("kind") == "call", F.col("once").isNotNull()).otherwise((F.col("kind") == "assignment") & F.col("form").isin("copy", "constant"))
    defs = defs.filter(fit).select("func_id", "var", F.col("block").alias("def_block"), F.col("idx").alias("def_idx"), F.col("aliased").alias("fragile"))
    links = t.ssa_uses.select("func_id", "block", "idx", "var").join(defs, ["func_id", "var"]).drop("var")
    return v.propagate_through_memory(t.flow_edges, links, t.flow_instr.filter("kind = 'relation'").select("func_id", "block", "idx"))


@query("identity_groups")
def identity_groups(t):
    """Merged variables of a week that cannot differ; arguments that no merge row makes are definitions."""
    edges = t.phi_args.filter("var <> arg").select("func_id", F.col("var").alias("src"), F.col("arg").alias("dst"))
    phis = t.phi_args.select("func_id", F.col("var").alias("node")).distinct()
    defined = t.phi_args.select("func_id", F.col("arg").alias("node")).distinct().join(phis, ["func_id", "node"], "left_anti")
    return v.identity_groups(edges, phis, defined)


@query("fold_groups", """w AS (SELECT func_id, dst AS node, src AS origin, 1 AS steps FROM ssa_copies UNION ALL
      SELECT w.func_id, w.node, c.src, w.steps + 1 FROM w JOIN ssa_copies c ON c.func_id = w.func_id AND c.dst = w.origin),
    r AS (SELECT func_id, node, arg_max(origin, steps) AS root FROM w GROUP BY ALL), n AS (SELECT * FROM r UNION SELECT func_id, root, root FROM r)
    SELECT n.func_id, n.node, CASE WHEN i.idx IS NULL OR i.form IN ('operation', 'constant') THEN n.root
      ELSE max(n.node) OVER (PARTITION BY n.func_id, n.root) END AS identity FROM n
    LEFT JOIN ssa_defs i ON i.func_id = n.func_id AND i.var = n.root""")
def fold_groups(t):
    kinds = t.ssa_defs.filter("form IN ('operation', 'constant')").select("func_id", F.col("var").alias("node"), F.col("form").alias("kind"))
    params = t.ssa_uses.filter("ver = 0").select("func_id", F.col("var").alias("node"), F.lit("parameter").alias("kind")).distinct()
    return v.fold_groups(t.ssa_copies, kinds.unionByName(params))


@query("majority_type", """c AS (SELECT p_brand AS brand, p_type AS type, count(*) AS n FROM part GROUP BY ALL)
    SELECT brand, coalesce(arg_max(type, (type NOT IN ('PROMO', 'SMALL'), n, type)) FILTER (WHERE type <> 'STANDARD'), 'STANDARD') AS type FROM c GROUP BY ALL""")
def majority_type(t):
    values = t.part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return v.majority_type(values, ["brand"], F.col("type").isin("PROMO", "SMALL"), unknown="STANDARD")


@query("type_groups", """e AS (SELECT DISTINCT func_id, def_var AS a, use_var AS b FROM flow_instr WHERE form = 'copy'),
    s AS (SELECT func_id, a, b FROM e UNION SELECT func_id, b, a FROM e UNION SELECT func_id, a, a FROM e UNION SELECT func_id, b, b FROM e),
    c AS (SELECT func_id, a, b FROM s UNION SELECT c.func_id, c.a, s.b FROM c JOIN s ON s.func_id = c.func_id AND s.a = c.b),
    g AS (SELECT func_id, a AS node, min(b) AS grp FROM c GROUP BY ALL),
    n AS (SELECT g.func_id, g.grp, i.type, count(*) AS n FROM g JOIN flow_instr i ON i.func_id = g.func_id AND i.def_var = g.node GROUP BY ALL),
    t AS (SELECT func_id, grp, arg_max(type, (type NOT IN ('view', 'click'), n, type)) FILTER (WHERE type <> 'error') AS type FROM n GROUP BY ALL)
    SELECT g.func_id, g.node, g.grp, coalesce(t.type, 'error') AS type FROM g LEFT JOIN t USING (func_id, grp)""")
def type_groups(t):
    edges = t.flow_instr.filter("form = 'copy'").select("func_id", F.col("def_var").alias("src"), F.col("use_var").alias("dst"))
    types = t.flow_instr.select("func_id", F.col("def_var").alias("node"), "type")
    return v.type_groups(edges, types, F.col("type").isin("view", "click"), unknown="error")


@query("placement", """u AS (SELECT func_id, use_var AS grp, block AS node, bool_or(kind = 'relation') AS in_phi FROM flow_instr GROUP BY ALL),
    s AS (SELECT func_id, grp, count(*) AS n FROM u GROUP BY ALL),
    c AS (SELECT u.func_id, u.grp, m.dom, count(*) AS n FROM u JOIN flow_dom m USING (func_id, node) GROUP BY ALL)
    SELECT c.func_id, c.grp, arg_max(c.dom, q.depth) AS block FROM c JOIN s USING (func_id, grp, n) JOIN flow_depth q
      ON q.func_id = c.func_id AND q.node = c.dom ANTI JOIN (SELECT * FROM u WHERE in_phi) x ON x.func_id = c.func_id AND x.grp = c.grp AND x.node = c.dom
    GROUP BY ALL""")
def placement(t):
    uses = t.flow_instr.select("func_id", F.col("use_var").alias("grp"), F.col("block").alias("node"), (F.col("kind") == "relation").alias("in_phi"))
    return v.placement(d.dominators(t.flow_edges, t.flow_roots), uses)


@query("reuse_pairs", """r AS (SELECT i.func_id, i.block, i.idx, i.aliased, u.var || '/' || (i.k % 2) AS fp, i.form IN ('operation', 'copy') AS usable
      FROM flow_instr i JOIN ssa_uses u USING (func_id, idx)),
    c AS (SELECT r.func_id, r.block, r.idx, e.idx AS def_idx, e.block AS def_block, e.aliased, q.depth FROM r JOIN r e ON e.func_id = r.func_id
      AND e.fp = r.fp AND e.usable JOIN flow_dom m ON m.func_id = r.func_id AND m.node = r.block AND m.dom = e.block
      JOIN flow_depth q ON q.func_id = r.func_id AND q.node = e.block WHERE e.block <> r.block OR e.idx < r.idx),
    b AS (SELECT func_id, idx, block, arg_min(def_idx, (depth, def_idx)) AS def_idx, arg_min(def_block, (depth, def_idx)) AS def_block,
      arg_min(aliased, (depth, def_idx)) AS aliased FROM c GROUP BY ALL)
    SELECT b.func_id, b.idx, b.def_idx FROM b WHERE NOT (b.aliased AND EXISTS (SELECT 1 FROM flow_instr g WHERE g.kind = 'relation' AND g.func_id = b.func_id
      AND CASE WHEN b.def_block = b.block THEN g.block = b.block AND g.idx >= b.def_idx AND g.idx < b.idx WHEN g.block = b.block THEN g.idx < b.idx
      WHEN g.block = b.def_block THEN g.idx > b.def_idx ELSE EXISTS (SELECT 1 FROM flow_star x JOIN flow_star y ON y.func_id = x.func_id AND y.src = x.dst
        WHERE x.func_id = b.func_id AND x.src = b.def_block AND x.dst = g.block AND y.dst = b.block) END))""")
def reuse_pairs(t):
    """Rows that repeat what a row on every way before them has worked out from the same version of a variable."""
    rows = t.flow_instr.join(t.ssa_uses.select("func_id", "idx", "var"), ["func_id", "idx"]).select(
        "func_id", "block", "idx", F.concat(F.col("var"), F.lit("/"), F.col("k") % 2).alias("fp"), F.col("form").isin("operation", "copy").alias("usable"), "aliased"
    )
    danger = t.flow_instr.filter("kind = 'relation'").select("func_id", "block", "idx")
    return v.reuse_pairs(t.flow_edges, d.dominators(t.flow_edges, t.flow_roots), rows, danger)


@query("dead_components", """e AS (SELECT func_id, 'i' || idx AS src, var AS dst FROM ssa_uses UNION ALL SELECT func_id, var, 'i' || idx FROM ssa_defs),
    w AS (SELECT func_id, 'i' || idx AS node FROM flow_instr WHERE kind IN ('call', 'branch', 'return') UNION
      SELECT e.func_id, e.dst FROM w JOIN e ON e.func_id = w.func_id AND e.src = w.node)
    SELECT func_id, src AS node FROM e EXCEPT SELECT func_id, node FROM w""")
def dead_components(t):
    uses = t.ssa_uses.select("func_id", F.concat(F.lit("i"), "idx").alias("src"), F.col("var").alias("dst"))
    defs = t.ssa_defs.select("func_id", F.col("var").alias("src"), F.concat(F.lit("i"), "idx").alias("dst"))
    edges = uses.unionByName(defs)
    sinks = t.flow_instr.filter("kind IN ('call', 'branch', 'return')").select("func_id", F.concat(F.lit("i"), "idx").alias("node"))
    return v.dead_components(edges, sinks, edges.select("func_id", F.col("src").alias("node")).distinct())


view("clash", """SELECT DISTINCT func_id, least(src, dst) AS a, greatest(src, dst) AS b FROM flow_edges WHERE src <> dst
    AND (split_part(src, '#', 1) IN ('view', 'click')) = (split_part(dst, '#', 1) IN ('view', 'click'))""")


def _clashes(t):
    return t.flow_edges.filter("src <> dst").select("func_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


@query("color_groups", """conf AS (SELECT func_id, a, b FROM clash UNION SELECT func_id, b, a FROM clash),
    deg AS (SELECT b.func_id, b.block AS node, count(x.b) AS n FROM flow_blocks b LEFT JOIN conf x ON x.func_id = b.func_id AND x.a = b.block GROUP BY ALL),
    o AS (SELECT func_id, node, row_number() OVER (PARTITION BY func_id ORDER BY n DESC, node) AS r FROM deg),
    adj AS (SELECT o.func_id, o.r, o.node, coalesce(list(p.r) FILTER (WHERE p.r IS NOT NULL), []) AS before FROM o
      LEFT JOIN conf x ON x.func_id = o.func_id AND x.a = o.node LEFT JOIN o p ON p.func_id = x.func_id AND p.node = x.b AND p.r < o.r GROUP BY ALL),
    w AS (SELECT func_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS colors FROM (SELECT DISTINCT func_id FROM o) UNION ALL
      SELECT a.func_id, a.r, list_append(w.colors, list_min(list_filter(range(0, 40), lambda c: NOT list_contains(list_transform(a.before, lambda j: w.colors[j]), c))))
      FROM w JOIN adj a ON a.func_id = w.func_id AND a.r = w.r + 1)
    SELECT a.func_id, a.node, w.colors[a.r] AS color FROM adj a JOIN w ON w.func_id = a.func_id AND w.r = a.r""")
def color_groups(t):
    """Blocks grouped so that no step leads from one block of a group to another of the same class."""
    cls = F.substring_index("block", "#", 1).isin("view", "click").cast("string").alias("cls")
    return v.color_groups(t.flow_blocks.select("func_id", F.col("block").alias("node"), cls), _clashes(t))


#: A round of the recursion holds the group of every node of a function as a list; pairs that no better pair touches are merged.
@query("merge_by_score", """n AS (SELECT func_id, block AS node, row_number() OVER (PARTITION BY func_id ORDER BY block) AS i FROM flow_blocks),
    s AS (SELECT func_id, least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS score FROM flow_steps WHERE src <> dst GROUP BY ALL),
    p AS (SELECT s.func_id, list({'a': x.i, 'b': y.i, 's': score, 'c': split_part(a, '#', 1) = split_part(b, '#', 1)}) AS pairs FROM s
      JOIN n x ON x.func_id = s.func_id AND x.node = a JOIN n y ON y.func_id = s.func_id AND y.node = b GROUP BY ALL),
    w AS (SELECT func_id, 0 AS round, list(i ORDER BY i) AS g, true AS more FROM n GROUP BY func_id UNION ALL
      SELECT func_id, round + 1, list_transform(g, lambda v: coalesce(list_filter(mutual, lambda m: m.y = v)[1].x, v)), len(mutual) > 0 FROM
      (SELECT *, list_filter(pairs_now, lambda k: len(list_filter(pairs_now, lambda o: (o.x IN (k.x, k.y) OR o.y IN (k.x, k.y)) AND {'s': o.s, 'x': o.x, 'y': o.y} > {'s': k.s, 'x': k.x, 'y': k.y})) = 0) AS mutual FROM
      (SELECT *, list_filter(list_transform(keys, lambda k: {'x': k.x, 'y': k.y, 's': list_sum(list_transform(list_filter(q, lambda o: o.x = k.x AND o.y = k.y), lambda o: o.s)),
        'c': list_bool_or(list_transform(list_filter(q, lambda o: o.x = k.x AND o.y = k.y), lambda o: o.c))}), lambda k: k.s > 0 AND NOT k.c) AS pairs_now FROM
      (SELECT *, list_distinct(list_transform(q, lambda o: {'x': o.x, 'y': o.y})) AS keys FROM
      (SELECT w.func_id, w.round, w.g, list_filter(list_transform(p.pairs, lambda o: {'x': least(w.g[o.a], w.g[o.b]), 'y': greatest(w.g[o.a], w.g[o.b]), 's': o.s, 'c': o.c}), lambda o: o.x <> o.y) AS q
        FROM w JOIN p ON p.func_id = w.func_id WHERE w.more))))),
    z AS (SELECT func_id, arg_max(g, round) AS g FROM w GROUP BY func_id)
    SELECT n.func_id, n.node, m.node AS grp FROM n JOIN z ON z.func_id = n.func_id JOIN n m ON m.func_id = n.func_id AND m.i = z.g[n.i]""")
def merge_by_score(t):
    """Blocks merged by how often a step joins them; a step inside an event type keeps its blocks apart."""
    steps = t.flow_steps.filter("src <> dst").select("func_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    scores = steps.groupBy("func_id", "a", "b").agg(F.count(F.lit(1)).alias("score"))
    conflicts = scores.filter(F.substring_index("a", "#", 1) == F.substring_index("b", "#", 1)).select("func_id", "a", "b")
    return v.merge_by_score(scores, conflicts, t.flow_blocks.select("func_id", F.col("block").alias("node")))
