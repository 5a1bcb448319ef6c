"""Definition, use and liveness queries over visitors' weeks read as programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import dataflow as f
from tributary.operators import dominance as d
from tributary.operators import versions as v
from tributary.plans.registry import query, view
from tributary.tables import keep

ROW = ["func_id", "block", "idx"]


def _defs(t):
    return t.flow_instr.select(*ROW, F.col("def_var").alias("var"))


def _uses(t):
    return t.flow_instr.select(*ROW, F.col("use_var").alias("var"))


@query("def_use", """SELECT u.func_id, u.idx, u.block, u.var, d.block AS def_block, d.idx AS def_idx FROM ssa_uses u
    LEFT JOIN ssa_defs d USING (func_id, var)""")
def def_use(t):
    return f.def_use(t.ssa_defs, t.ssa_uses.select(*ROW, "var"))


@query("undefined_vars", "SELECT DISTINCT func_id, var FROM ssa_uses u ANTI JOIN ssa_defs d USING (func_id, var)")
def undefined_vars(t):
    return f.undefined_vars(t.ssa_defs, t.ssa_uses)


@query("ssa_violations", "SELECT func_id, def_var AS var, count(*) AS n FROM flow_instr GROUP BY ALL HAVING count(*) > 1")
def ssa_violations(t):
    return f.ssa_violations(_defs(t))


@query("asof_def", """SELECT u.func_id, u.block, u.idx, u.use_var AS var, d.idx AS def_idx FROM flow_instr u ASOF LEFT JOIN flow_instr d
    ON d.func_id = u.func_id AND d.block = u.block AND d.def_var = u.use_var AND u.idx >= d.idx""")
def asof_def(t):
    return f.asof_def(_defs(t), _uses(t))


@query("row_states", """SELECT u.func_id, u.block, u.idx, u.use_var AS var, max(d.idx) FILTER (WHERE d.idx < u.idx) AS before_idx,
    max(d.idx) AS after_idx FROM flow_instr u LEFT JOIN flow_instr d
    ON d.func_id = u.func_id AND d.block = u.block AND d.def_var = u.use_var AND d.idx <= u.idx GROUP BY ALL""")
def row_states(t):
    return f.row_states(_defs(t), _uses(t))


view("last_def", "SELECT func_id, block, def_var AS var, max(idx) AS def_idx FROM flow_instr GROUP BY ALL")
view("reach_in", """SELECT e.func_id, e.dst AS block, l.var, l.def_idx FROM last_def l JOIN flow_edges e ON e.func_id = l.func_id AND e.src = l.block
    UNION SELECT e.func_id, e.dst, r.var, r.def_idx FROM reach_in r JOIN flow_edges e ON e.func_id = r.func_id AND e.src = r.block
    LEFT JOIN last_def l ON l.func_id = r.func_id AND l.block = r.block AND l.var = r.var WHERE l.var IS NULL""")


@query("reaching_defs", "SELECT func_id, block, var, def_idx FROM reach_in")
def reaching_defs(t):
    return f.reaching_defs(t.flow_edges, _defs(t))


@query("reaching_out", """SELECT func_id, block, var, def_idx FROM last_def UNION ALL SELECT func_id, block, var, def_idx
    FROM reach_in r ANTI JOIN last_def l USING (func_id, block, var)""")
def reaching_out(t):
    return f.reaching_out(t.flow_edges, _defs(t), f.reaching_defs(t.flow_edges, _defs(t)))


@query("asof_def_cfg", """u AS (SELECT func_id, block, idx, use_var AS var, (SELECT max(d.idx) FROM flow_instr d WHERE d.func_id = i.func_id
      AND d.block = i.block AND d.def_var = i.use_var AND d.idx < i.idx) AS def_idx FROM flow_instr i)
    SELECT * FROM u WHERE def_idx IS NOT NULL UNION ALL SELECT u.func_id, u.block, u.idx, u.var, r.def_idx FROM u
    JOIN reach_in r USING (func_id, block, var) WHERE u.def_idx IS NULL""")
def asof_def_cfg(t):
    """The definitions every use may read, through the graph where its block has none."""
    return f.reaching_uses(t.flow_edges, _defs(t), _uses(t))


@query("block_summary", """SELECT func_id, block, var, max(d) = 1 AS is_defined, max(d) = 0 AS is_dependency FROM (SELECT func_id, block,
    def_var AS var, 1 AS d FROM flow_instr UNION ALL SELECT func_id, block, use_var, 0 FROM flow_instr) GROUP BY ALL""")
def block_summary(t):
    return f.block_summary(_defs(t), _uses(t))


view("lv_def", "SELECT func_id, block, idx, var FROM ssa_defs")
view("lv_phi", "SELECT DISTINCT func_id, block, var FROM phi_args")
view("lv_read", "SELECT func_id, block, var FROM ssa_uses UNION SELECT func_id, pred_block, arg FROM phi_args")
view("lv_in", """SELECT r.func_id, r.block, r.var FROM lv_read r ANTI JOIN lv_def d USING (func_id, block, var) UNION
    SELECT e.func_id, e.src, i.var FROM lv_in i JOIN flow_edges e ON e.func_id = i.func_id AND e.dst = i.block
    LEFT JOIN lv_phi p ON p.func_id = i.func_id AND p.block = i.block AND p.var = i.var
    LEFT JOIN lv_def d ON d.func_id = e.func_id AND d.block = e.src AND d.var = i.var WHERE p.var IS NULL AND d.var IS NULL""")
view("lv_out", """SELECT e.func_id, e.src AS block, i.var FROM lv_in i JOIN flow_edges e ON e.func_id = i.func_id AND e.dst = i.block
    ANTI JOIN lv_phi p ON p.func_id = i.func_id AND p.block = i.block AND p.var = i.var UNION
    SELECT func_id, pred_block, arg FROM phi_args""")


def _live_inputs(t):
    phi_defs = t.phi_args.select("func_id", "block", "var").distinct()
    return t.ssa_defs.select(*ROW, "var"), t.ssa_uses.select(*ROW, "var"), phi_defs, t.phi_args.select("func_id", F.col("pred_block").alias("block"), F.col("arg").alias("var"))


@query("liveness", "SELECT func_id, block, var, 'in' AS side FROM lv_in UNION ALL SELECT func_id, block, var, 'out' FROM lv_out")
def liveness(t):
    live_in, live_out = f.liveness(t.flow_edges, *_live_inputs(t))
    return live_in.withColumn("side", F.lit("in")).unionByName(live_out.withColumn("side", F.lit("out")))


@query("interference", """after_row AS (SELECT p.func_id, p.block, p.idx, o.var FROM lv_def p JOIN lv_out o USING (func_id, block)
      WHERE NOT EXISTS (SELECT 1 FROM lv_def d WHERE d.func_id = p.func_id AND d.block = p.block AND d.var = o.var AND d.idx > p.idx) UNION
      SELECT p.func_id, p.block, p.idx, u.var FROM lv_def p JOIN ssa_uses u ON u.func_id = p.func_id AND u.block = p.block AND u.idx > p.idx
      WHERE NOT EXISTS (SELECT 1 FROM lv_def d WHERE d.func_id = p.func_id AND d.block = p.block AND d.var = u.var AND d.idx > p.idx)),
    point AS (SELECT func_id, 'i' || block AS p, var FROM lv_in UNION SELECT func_id, 'o' || block, var FROM lv_out UNION
      SELECT func_id, 'r' || idx, var FROM after_row UNION SELECT func_id, 'r' || idx, var FROM lv_def UNION SELECT func_id, 'i' || block, var FROM lv_phi)
    SELECT DISTINCT x.func_id, x.var AS a, y.var AS b FROM point x JOIN point y ON y.func_id = x.func_id AND y.p = x.p AND x.var < y.var""")
def interference(t):
    return f.interference(t.flow_edges, t.flow_roots, *_live_inputs(t))


@query("dead_rows", """live AS (SELECT func_id, idx FROM flow_instr WHERE kind <> 'assignment' UNION
      SELECT u.func_id, u.ver FROM live l JOIN ssa_uses u USING (func_id, idx) WHERE u.ver > 0),
    need AS (SELECT u.func_id, u.ver AS idx FROM live l JOIN ssa_uses u USING (func_id, idx) WHERE u.ver > 0)
    SELECT func_id, idx, 'dead' AS status FROM flow_instr i ANTI JOIN live USING (func_id, idx) WHERE kind IN ('assignment', 'call') UNION ALL
    SELECT func_id, idx, 'dead_result' FROM flow_instr i ANTI JOIN need USING (func_id, idx) WHERE kind = 'call'""")
def dead_rows(t):
    results = t.flow_instr.filter("kind IN ('assignment', 'call')").select("func_id", "idx")
    sinks = t.flow_instr.filter("kind <> 'assignment'").select("func_id", "idx")
    depends = t.ssa_uses.filter("ver > 0").select("func_id", "idx", F.col("ver").alias("on_idx"))
    return f.dead_rows(sinks, results, depends)


view("pair", """SELECT u.func_id, u.idx AS pair, d.block AS def_block, d.idx AS def_idx, u.block AS use_block, u.idx AS use_idx
    FROM ssa_uses u JOIN ssa_defs d ON d.func_id = u.func_id AND d.idx = u.ver""")


@query("unsafe_between", """danger AS (SELECT func_id, block, idx FROM flow_instr WHERE kind = 'relation'),
    star AS (SELECT func_id, src, dst FROM flow_closure UNION SELECT func_id, block, block FROM flow_blocks)
    SELECT DISTINCT p.* FROM pair p JOIN danger g ON g.func_id = p.func_id AND CASE WHEN p.def_block = p.use_block
      THEN g.block = p.def_block AND g.idx >= p.def_idx AND g.idx < p.use_idx WHEN g.block = p.use_block THEN g.idx < p.use_idx
      WHEN g.block = p.def_block THEN g.idx > p.def_idx ELSE EXISTS (SELECT 1 FROM star a JOIN star b ON b.func_id = a.func_id AND b.src = a.dst
        WHERE a.func_id = p.func_id AND a.src = p.def_block AND a.dst = g.block AND b.dst = p.use_block) END""")
def unsafe_between(t):
    """Definition and use with a relation row between."""
    pairs = f.def_use(t.ssa_defs, t.ssa_uses.select(*ROW, "var")).filter("def_idx IS NOT NULL")
    pairs = pairs.select("func_id", F.col("idx").alias("pair"), "def_block", "def_idx", F.col("block").alias("use_block"), F.col("idx").alias("use_idx"))
    return f.unsafe_between(t.flow_edges, pairs, t.flow_instr.filter("kind = 'relation'").select(*ROW))


view("branching", """SELECT func_id, src, dst, CASE WHEN n <> 2 THEN 'unconditional' WHEN dst = low THEN 'true' ELSE 'false' END AS kind FROM
    (SELECT func_id, src, dst, count(*) OVER w AS n, min(dst) OVER w AS low FROM flow_edges WINDOW w AS (PARTITION BY func_id, src))""")


def _branching(t):
    """Steps as branch edges: of two steps the smaller target is the true one."""
    outs = t.flow_edges.groupBy("func_id", "src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("low"))
    kind = F.when(F.col("n") != 2, "unconditional").when(F.col("dst") == F.col("low"), "true").otherwise("false")
    return keep(t.flow_edges.join(outs, ["func_id", "src"]).select("func_id", "src", "dst", kind.alias("kind")))


view("cond", """SELECT b.func_id, b.block AS src, i.k % 2 = 0 AS holds FROM flow_blocks b JOIN flow_instr i ON i.func_id = b.func_id AND i.idx = b.last_idx
    WHERE i.form = 'constant' AND EXISTS (SELECT 1 FROM branching e WHERE e.func_id = b.func_id AND e.src = b.block AND e.kind = 'true')""")
view("kept", "SELECT e.*, c.holds FROM branching e LEFT JOIN cond c USING (func_id, src) WHERE c.holds IS NULL OR (e.kind = 'true') = c.holds")
view("kept_reach", """SELECT func_id, root AS node FROM flow_roots UNION
    SELECT k.func_id, k.dst FROM kept_reach r JOIN kept k ON k.func_id = r.func_id AND k.src = r.node""")


def _dead_paths(t):
    edges = _branching(t)
    last = t.flow_blocks.select("func_id", "block", F.col("last_idx").alias("idx")).join(t.flow_instr.filter("form = 'constant'"), ROW)
    last = last.select("func_id", F.col("block").alias("src"), (F.col("k") % 2 == 0).alias("holds"))
    cond = keep(last.join(edges.filter("kind = 'true'").select("func_id", "src"), ["func_id", "src"], "left_semi"))
    return f.dead_paths(edges, t.flow_roots, t.flow_blocks.select("func_id", F.col("block").alias("node")), cond)


@query("dead_paths", """SELECT e.func_id, e.src, e.dst, 'dead' AS kind FROM branching e JOIN cond c USING (func_id, src) WHERE (e.kind = 'true') <> c.holds
    UNION ALL SELECT k.func_id, k.src, k.dst, CASE WHEN k.holds IS NULL THEN k.kind ELSE 'unconditional' END FROM kept k
      JOIN kept_reach r ON r.func_id = k.func_id AND r.node = k.src
    UNION ALL SELECT b.func_id, b.block, NULL, 'gone' FROM flow_blocks b ANTI JOIN kept_reach r ON r.func_id = b.func_id AND r.node = b.block""")
def dead_paths(t):
    left, dead, gone = _dead_paths(t)
    return left.unionByName(dead.withColumn("kind", F.lit("dead"))).unionByName(
        gone.select("func_id", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit("gone").alias("kind"))
    )


@query("prune_phi_args", """SELECT p.func_id, p.block, p.var, p.pred_block, p.arg, p.name FROM phi_args p
    JOIN kept_reach r ON r.func_id = p.func_id AND r.node = p.pred_block""")
def prune_phi_args(t):
    return f.prune_phi_args(t.phi_args, _dead_paths(t)[2])


view("phi_value", """SELECT p.func_id, p.var, p.pred_block, CASE WHEN i.form = 'constant' THEN i.k % 2 END AS value FROM phi_args p
    JOIN last_def l ON l.func_id = p.func_id AND l.block = p.pred_block AND l.var = p.name
    JOIN flow_instr i ON i.func_id = l.func_id AND i.idx = l.def_idx""")
view("phi_test", """SELECT e.func_id, e.src, min(p.var) AS var, 1 AS constant, true AS equal FROM branching e JOIN phi_args p
    ON p.func_id = e.func_id AND p.block = e.src WHERE e.kind = 'true' GROUP BY e.func_id, e.src""")


@query("dead_loops", """u AS (SELECT b.func_id, b.src, b.constant, b.equal, any_value(x.value) AS value FROM phi_test b
      JOIN phi_value x ON x.func_id = b.func_id AND x.var = b.var
      LEFT JOIN flow_dom m ON m.func_id = b.func_id AND m.dom = b.src AND m.node = x.pred_block
      WHERE x.pred_block = b.src OR m.node IS NULL GROUP BY ALL HAVING count(*) = 1 AND count(x.value) = 1),
    o AS (SELECT e.*, CASE WHEN (u.value = u.constant) = u.equal THEN 'true' ELSE 'false' END AS taken FROM branching e JOIN u USING (func_id, src)
      WHERE e.kind IN ('true', 'false'))
    SELECT o.func_id, o.src, o.dst, o.kind FROM o JOIN o w ON w.func_id = o.func_id AND w.src = o.src AND w.kind = w.taken
    ANTI JOIN flow_closure c ON c.func_id = w.func_id AND c.src = w.dst AND c.dst = w.src WHERE o.kind <> o.taken AND w.dst <> w.src""")
def dead_loops(t):
    """Blocks that test whether their first merged variable comes in as 1."""
    edges = _branching(t)
    last = t.flow_instr.groupBy("func_id", "block", F.col("def_var").alias("name")).agg(F.max("idx").alias("idx"))
    value = F.when(F.col("form") == "constant", F.col("k") % 2).alias("value")
    values = last.join(t.flow_instr, ROW).select("func_id", F.col("block").alias("pred_block"), "name", value)
    values = t.phi_args.join(values, ["func_id", "pred_block", "name"]).select("func_id", "var", "pred_block", "value")
    tests = t.phi_args.groupBy("func_id", F.col("block").alias("src")).agg(F.min("var").alias("var"))
    tests = tests.join(edges.filter("kind = 'true'").select("func_id", "src"), ["func_id", "src"], "left_semi")
    tests = tests.select("func_id", "src", "var", F.lit(1).alias("constant"), F.lit(True).alias("equal"))
    return f.dead_loops(edges, d.dominators(t.flow_edges, t.flow_roots), tests, values)


@query("backward_slice", """w AS (SELECT i.func_id, i.idx AS seed, i.idx AS node, 0 AS depth FROM flow_instr i WHERE kind = 'branch' UNION
      SELECT w.func_id, w.seed, u.ver, w.depth + 1 FROM w JOIN ssa_uses u ON u.func_id = w.func_id AND u.idx = w.node
      JOIN flow_instr i ON i.func_id = w.func_id AND i.idx = w.node WHERE u.ver > 0 AND i.form <> 'copy')
    SELECT w.func_id, w.seed, arg_min(w.node, (w.depth, w.node)) AS node, min(w.depth) AS depth FROM w JOIN flow_instr i
      ON i.func_id = w.func_id AND i.idx = w.node WHERE i.form = 'copy' GROUP BY ALL""")
def backward_slice(t):
    """From every branch back to the nearest copy its value comes from."""
    depends = t.ssa_uses.filter("ver > 0").select("func_id", F.col("idx").alias("node"), F.col("ver").alias("on"))
    seeds = t.flow_instr.filter("kind = 'branch'").select("func_id", F.col("idx").alias("node"))
    return f.backward_slice(depends, seeds, t.flow_instr.filter("form = 'copy'").select("func_id", F.col("idx").alias("node")))


@query("call_edges", """SELECT 'u' || user_id AS caller, 'f' || k AS callee, count(*) AS n FROM ev WHERE k % 10 = 6 GROUP BY ALL""")
def call_edges(t):
    calls = t.flow_instr.filter("kind = 'call'")
    return f.call_edges(calls.select(F.concat(F.lit("u"), F.floor(F.col("func_id") / 100)).alias("caller"), F.concat(F.lit("f"), "k").alias("callee")))


view("aliased_vars", "SELECT DISTINCT func_id, def_var AS name FROM flow_instr WHERE aliased")
view("memory", "SELECT func_id, block, idx AS version FROM flow_instr WHERE kind IN ('call', 'relation')")


def _aliased(t):
    return t.flow_instr.filter("aliased").select("func_id", F.col("def_var").alias("name")).distinct()


def _memory(t):
    return t.flow_instr.filter("kind IN ('call', 'relation')").select("func_id", "block", F.col("idx").alias("version"))


@query("expand_mem_phi", """SELECT p.func_id, p.block, a.name, a.name || '#' || p.idx AS var, p.pred_block, a.name || '#' || p.ver AS arg FROM
    (SELECT e.func_id, e.dst AS block, b.last_idx AS idx, e.src AS pred_block, max(m.version) AS ver FROM flow_edges e
      JOIN flow_blocks b ON b.func_id = e.func_id AND b.block = e.dst JOIN memory m ON m.func_id = e.func_id AND m.block = e.src GROUP BY ALL) p
    JOIN aliased_vars a USING (func_id)""")
def expand_mem_phi(t):
    """Merge rows of the memory state, one per block and predecessor that changes memory, spelled out per aliased variable."""
    last = _memory(t).groupBy("func_id", F.col("block").alias("src")).agg(F.max("version").alias("ver"))
    phis = t.flow_edges.join(last, ["func_id", "src"]).join(
        t.flow_blocks.select("func_id", F.col("block").alias("dst"), F.col("last_idx").alias("idx")), ["func_id", "dst"]
    )
    return v.expand_mem_phi(phis.select("func_id", F.col("dst").alias("block"), "idx", F.col("src").alias("pred_block"), "ver"), _aliased(t))


@query("missing_versions", """SELECT a.func_id, a.name, m.version FROM aliased_vars a JOIN memory m USING (func_id) EXCEPT
    SELECT func_id, def_var, idx FROM flow_instr""")
def missing_versions(t):
    existing = t.flow_instr.select("func_id", F.col("def_var").alias("name"), F.col("idx").alias("version"))
    return v.missing_versions(_aliased(t), _memory(t), existing)


@query("nearest_dominating", """p AS (SELECT DISTINCT func_id, block, use_var AS name FROM flow_instr),
    k AS (SELECT func_id, block, def_var AS name, max(idx) AS version FROM flow_instr GROUP BY ALL)
    SELECT p.func_id, p.block, p.name, arg_max(k.version, q.depth) AS version FROM p JOIN flow_dom m ON m.func_id = p.func_id AND m.node = p.block
    JOIN k ON k.func_id = p.func_id AND k.block = m.dom AND k.name = p.name JOIN flow_depth q ON q.func_id = m.func_id AND q.node = m.dom GROUP BY ALL""")
def nearest_dominating(t):
    points = t.flow_instr.select("func_id", "block", F.col("use_var").alias("name")).distinct()
    known = t.flow_instr.select("func_id", "block", F.col("def_var").alias("name"), F.col("idx").alias("version"))
    return v.nearest_dominating(points, known, d.dominators(t.flow_edges, t.flow_roots))


@query("phi_origins", """j AS (SELECT DISTINCT func_id, block, name FROM phi_args),
    k AS (SELECT func_id, block, def_var AS name, max(idx) AS version FROM flow_instr GROUP BY ALL),
    a AS (SELECT j.func_id, j.block, j.name, e.src AS pred_block FROM j JOIN flow_edges e ON e.func_id = j.func_id AND e.dst = j.block),
    h AS (SELECT a.func_id, a.block, a.name, a.pred_block, arg_max(k.version, q.depth) AS version, arg_max(k.block, q.depth) AS def_block FROM a
      JOIN flow_dom m ON m.func_id = a.func_id AND m.node = a.pred_block JOIN k ON k.func_id = a.func_id AND k.block = m.dom AND k.name = a.name
      JOIN flow_depth q ON q.func_id = m.func_id AND q.node = m.dom GROUP BY ALL)
    SELECT a.*, h.version, h.def_block FROM a LEFT JOIN h USING (func_id, block, name, pred_block)""")
def phi_origins(t):
    """What every merge row gets from every predecessor: the last definition in the predecessor or the nearest block dominating it."""
    phis = t.phi_args.select("func_id", "block", "name").distinct()
    known = t.flow_instr.select("func_id", "block", F.col("def_var").alias("name"), F.col("idx").alias("version"))
    return v.phi_origins(phis, t.flow_edges, known, d.dominators(t.flow_edges, t.flow_roots))


@query("points_to", """w AS (SELECT func_id, def_var AS ptr, 'x_' || use_var AS target FROM flow_instr WHERE form = 'address' UNION
    SELECT w.func_id, i.def_var, w.target FROM w JOIN flow_instr i ON i.func_id = w.func_id AND i.use_var = w.ptr WHERE i.form = 'copy')
    SELECT func_id, ptr, target FROM w""")
def points_to(t):
    rows = t.flow_instr
    seeds = rows.filter("form = 'address'").select("func_id", F.col("def_var").alias("ptr"), F.concat(F.lit("x_"), "use_var").alias("target"))
    copies = rows.filter("form = 'copy'").select("func_id", F.col("use_var").alias("src"), F.col("def_var").alias("dst"))
    return v.points_to(seeds, copies)


@query("shared_var", """u AS (SELECT DISTINCT func_id, block, use_var AS var FROM flow_instr)
    SELECT e.func_id, e.src, e.dst, min(a.var) AS var FROM flow_edges e JOIN u a ON a.func_id = e.func_id AND a.block = e.src
    JOIN u b ON b.func_id = e.func_id AND b.block = e.dst AND b.var = a.var WHERE e.src <> e.dst GROUP BY ALL HAVING count(*) = 1""")
def shared_var(t):
    """Steps between blocks that use exactly one variable in common."""
    uses = t.flow_instr.select("func_id", F.col("block").alias("item"), F.col("use_var").alias("var")).distinct()
    pairs = t.flow_edges.filter("src <> dst").select("func_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    return v.shared_var(pairs, uses).withColumnsRenamed({"a": "src", "b": "dst"})


#: Merge rows in names that are not of single definition: an argument is the row's own variable, another one or a constant, by the last
#: definition in the predecessor. So rows refer to themselves and to others of their block, in chains and in cycles.
view("phi_rows", """SELECT DISTINCT p.func_id, p.block, p.name AS var,
    CASE i.k % 3 WHEN 0 THEN i.use_var WHEN 1 THEN p.name ELSE p.name || '@' || (i.k % 2) END AS arg
    FROM phi_args p JOIN last_def l ON l.func_id = p.func_id AND l.block = p.pred_block AND l.var = p.name
    JOIN flow_instr i ON i.func_id = l.func_id AND i.idx = l.def_idx""")
view("phi_dep", """SELECT DISTINCT p.func_id, p.block, p.var AS src, q.var AS dst FROM phi_rows p
    JOIN phi_rows q ON q.func_id = p.func_id AND q.block = p.block AND q.var = p.arg WHERE p.var <> q.var""")


def _phi_rows(t):
    last = t.flow_instr.groupBy("func_id", F.col("block").alias("pred_block"), F.col("def_var").alias("name"))
    last = last.agg(F.max_by(F.struct("k", "use_var"), "idx").alias("l"))
    own = F.concat(F.col("name"), F.lit("@"), (F.col("l.k") % 2).cast("string"))
    arg = F.when(F.col("l.k") % 3 == 0, F.col("l.use_var")).when(F.col("l.k") % 3 == 1, F.col("name")).otherwise(own)
    rows = t.phi_args.join(last, ["func_id", "pred_block", "name"])
    return rows.select("func_id", "block", F.col("name").alias("var"), arg.alias("arg")).distinct()


@query("phi_deps", "SELECT func_id, block, src, dst FROM phi_dep")
def phi_deps(t):
    return v.phi_deps(_phi_rows(t))


@query("phi_cycles", """c AS (SELECT func_id, block, src, dst FROM phi_dep UNION SELECT c.func_id, c.block, c.src, e.dst FROM c JOIN phi_dep e
    ON e.func_id = c.func_id AND e.block = c.block AND e.src = c.dst) SELECT func_id, block, src AS var FROM c WHERE src = dst""")
def phi_cycles(t):
    return v.phi_cycles(_phi_rows(t))


@query("trivial_phis", """a AS (SELECT func_id, block, var, CASE WHEN count(DISTINCT arg) = 1 THEN min(arg) END AS value FROM phi_rows GROUP BY ALL),
    gone AS (SELECT * FROM a WHERE value = var OR (value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a m
        WHERE m.func_id = a.func_id AND m.block = a.block AND m.var = a.value))
      UNION SELECT a.* FROM a JOIN gone g ON g.func_id = a.func_id AND g.block = a.block AND g.var = a.value)
    SELECT func_id, block, var, value, CASE WHEN var = value THEN 'drop' ELSE 'copy' END AS action FROM gone""")
def trivial_phis(t):
    return v.trivial_phis(_phi_rows(t))
