"""Counting, ranking and expression queries over events, order lines and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.functions import scalar as s
from tributary.functions.ordered import Ordered
from tributary.operators import mining as m
from tributary.operators import trees as tr
from tributary.plans.registry import query, view
from tributary.tables import keep

view("occ", "SELECT func_id, def_var AS name, k % 3 AS ssa, type, aliased, idx AS ord FROM flow_instr")


def _occurrences(t):
    return t.flow_instr.select("func_id", F.col("def_var").alias("name"), (F.col("k") % 3).alias("ssa"), "type", "aliased", F.col("idx").alias("ord"))


@query("var_registry", "SELECT func_id, name, ssa, count(*) AS n FROM occ GROUP BY ALL")
def var_registry(t):
    return m.var_registry(_occurrences(t))


@query("harmonize_type", """SELECT func_id, name, ssa, aliased, ord, arg_min(type, ord) OVER (PARTITION BY func_id, name, ssa) AS type FROM occ""")
def harmonize_type(t):
    return m.harmonize_type(_occurrences(t))


@query("harmonize_aliased", """SELECT func_id, name, ssa, type, ord, bool_or(aliased) OVER (PARTITION BY func_id, name) AS aliased FROM occ""")
def harmonize_aliased(t):
    return m.harmonize_aliased(_occurrences(t))


# two expressions per order line, the smaller one part of the larger, and the line's ship date as a long string constant
view("expr_uses", """SELECT l_orderkey AS func_id, idx, fp, n, complexity, text, barred FROM (
    SELECT l_orderkey, idx, l_returnflag || '+' || l_linestatus AS fp, 1 + l_linenumber % 2 AS n, 2 AS complexity, NULL AS text, false AS barred FROM line_rows
    UNION ALL SELECT l_orderkey, idx, '(' || l_returnflag || '+' || l_linestatus || ')*' || l_linenumber, 1, 3, NULL, l_linenumber = 7 FROM line_rows
    UNION ALL SELECT l_orderkey, idx, strftime(l_shipdate, '%Y-%m-%d'), 1, 1, strftime(l_shipdate, '%Y-%m-%d'), false FROM line_rows)""")


def _expr_uses(t):
    rows = t.line_rows
    small = F.concat_ws("+", "l_returnflag", "l_linestatus")
    large = F.concat(F.lit("("), small, F.lit(")*"), F.col("l_linenumber"))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")

    def one(fp, n, complexity, text, barred):
        return F.struct(
            fp.alias("fp"), n.cast("int").alias("n"), F.lit(complexity).alias("complexity"), text.cast("string").alias("text"), barred.alias("barred")
        )

    no, none = F.lit(False), F.lit(None)
    entries = F.array(
        one(small, 1 + F.col("l_linenumber") % 2, 2, none, no),
        one(large, F.lit(1), 3, none, F.col("l_linenumber") == 7),
        one(day, F.lit(1), 1, day, no),
    )
    return keep(rows.select(F.col("l_orderkey").alias("func_id"), "idx", F.explode(entries).alias("e")).select("func_id", "idx", "e.*"))


@query("common_expr", """SELECT func_id, fp, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n FROM expr_uses WHERE NOT barred GROUP BY func_id, fp
    HAVING count(*) >= 2 AND (max(complexity) >= 2 OR max(length(text)) >= 8)""")
def common_expr(t):
    return m.common_expr(_expr_uses(t))


@query("common_expr_intra", """SELECT func_id, fp, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n FROM expr_uses WHERE NOT barred GROUP BY func_id, fp
    HAVING (max(complexity) >= 2 AND sum(n) >= 3) OR (max(length(text)) >= 8 AND sum(n) >= 2)""")
def common_expr_intra(t):
    return m.common_expr(_expr_uses(t), threshold=3, intra=True)


@query("common_expr_greedy", """u AS (SELECT * FROM expr_uses WHERE NOT barred),
    big AS (SELECT func_id, fp, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n FROM u WHERE complexity = 3 GROUP BY ALL HAVING count(*) >= 2),
    gone AS (SELECT u.func_id, split_part(substr(u.fp, 2), ')', 1) AS fp, u.idx, sum(u.n) AS c FROM u JOIN big USING (func_id, fp) GROUP BY ALL),
    small AS (SELECT u.func_id, u.fp, u.n - coalesce(g.c, 0) AS n FROM u LEFT JOIN gone g USING (func_id, fp, idx) WHERE u.complexity = 2)
    SELECT * FROM big UNION ALL SELECT func_id, fp, count(*) FILTER (WHERE n > 0), CAST(sum(n) AS BIGINT) FROM small GROUP BY ALL HAVING count(*) FILTER (WHERE n > 0) >= 2
    UNION ALL SELECT func_id, fp, count(*), CAST(sum(n) AS BIGINT) FROM u WHERE complexity = 1 AND length(text) >= 8 GROUP BY ALL HAVING count(*) >= 2""")
def common_expr_greedy(t):
    uses = _expr_uses(t)
    inner = F.regexp_extract("fp", r"^\(([^)]*)\)", 1)
    parts = uses.filter("complexity = 3").select("func_id", "fp", inner.alias("part"), F.lit(1).alias("n")).distinct()
    return m.common_expr_greedy(uses, parts)


@query("hot_expr", """SELECT func_id, fp, max(complexity) AS complexity, count(DISTINCT idx) AS parents FROM expr_uses GROUP BY ALL
    HAVING max(complexity) >= 2 AND count(DISTINCT idx) >= 2 AND max(complexity) * count(DISTINCT idx) > 5""")
def hot_expr(t):
    return m.hot_expr(_expr_uses(t).withColumnRenamed("idx", "parent"))


view("access", """SELECT CAST(0 AS BIGINT) AS func_id, l_orderkey AS base, idx, CASE l_linenumber % 3 WHEN 0 THEN 'const' WHEN 1 THEN 'mul' ELSE 'var' END AS cls,
    CASE l_linenumber % 3 WHEN 0 THEN (l_suppkey % 16) * CASE WHEN l_linenumber = 3 THEN 4 ELSE 2 END
      WHEN 1 THEN CASE WHEN l_partkey % 8 < 7 THEN 4 ELSE 8 END ELSE 1 END AS value,
    CASE WHEN l_orderkey % 3 = 0 THEN 4 ELSE 0 END AS element FROM line_rows""")


@query("strided_access", """b AS (SELECT base, list(DISTINCT value) FILTER (WHERE cls = 'var') AS v, list(DISTINCT value) FILTER (WHERE cls = 'mul') AS m,
      list(DISTINCT value) FILTER (WHERE cls = 'const') AS c, max(element) AS known FROM access GROUP BY ALL),
    o AS (SELECT base, known, c, CASE WHEN len(v) = 1 AND coalesce(len(m), 0) = 0 THEN v[1] WHEN len(m) = 1 AND coalesce(len(v), 0) = 0 THEN m[1] END AS stride FROM b)
    SELECT a.*, o.stride, CASE WHEN a.cls = 'const' THEN a.value // o.stride END AS index, o.known > 0 AS confident FROM access a JOIN o USING (base)
    WHERE o.stride IS NOT NULL AND (o.known = 0 OR o.known = o.stride) AND len(list_filter(coalesce(o.c, []), lambda x: x % o.stride <> 0)) = 0""")
def strided_access(t):
    line = F.col("l_linenumber")
    cls = F.when(line % 3 == 0, "const").when(line % 3 == 1, "mul").otherwise("var")
    offset = (F.col("l_suppkey") % 16) * F.when(line == 3, 4).otherwise(2)
    value = F.when(line % 3 == 0, offset).when(line % 3 == 1, F.when(F.col("l_partkey") % 8 < 7, 4).otherwise(8)).otherwise(1)
    rows = t.line_rows.select(
        F.lit(0).cast("bigint").alias("func_id"), F.col("l_orderkey").alias("base"), "idx", cls.alias("cls"), value.cast("bigint").alias("value"),
        F.when(F.col("l_orderkey") % 3 == 0, 4).otherwise(0).alias("element"),
    )
    return m.strided_access(keep(rows))


@query("modal_class", """SELECT func_id, name, arg_min(cls, (-n, cls)) AS cls FROM (SELECT func_id, def_var AS name, type AS cls, count(*) AS n
    FROM flow_instr WHERE type IN ('view', 'click', 'purchase') GROUP BY ALL) GROUP BY ALL""")
def modal_class(t):
    return m.modal_class(t.flow_instr.select("func_id", F.col("def_var").alias("name"), F.col("type").alias("cls")), ["view", "click", "purchase"])


view("report_rows", """SELECT o_orderstatus <> 'P' AS is_successful, c_mktsegment AS arch, o_orderpriority AS platform, o_totalprice AS seconds, o_orderkey % 1000 AS function_size,
    o_orderpriority AS exception, o_orderdate AS timestamp FROM orders JOIN customer ON c_custkey = o_custkey""")


def _reports(t):
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        (F.col("o_orderstatus") != "P").alias("is_successful"), F.col("c_mktsegment").alias("arch"), F.col("o_orderpriority").alias("platform"),
        F.col("o_totalprice").alias("seconds"), (F.col("o_orderkey") % 1000).alias("function_size"), F.col("o_orderpriority").alias("exception"), F.col("o_orderdate").alias("timestamp"),
    )


@query("report_summary", """SELECT arch, platform, count(*) AS n, count(*) FILTER (WHERE is_successful) AS n_ok,
    round(count(*) FILTER (WHERE is_successful) / count(*), 6) AS success_rate, round(avg(seconds), 4) AS avg_seconds,
    round(quantile_cont(seconds, 0.5), 4) AS median_seconds, round(quantile_cont(seconds, 0.9), 4) AS p90_seconds, max(seconds) AS max_seconds,
    round(avg(function_size), 4) AS avg_size, max(function_size) AS max_size
    FROM report_rows GROUP BY ROLLUP (arch, platform)""")
def report_summary(t):
    rounded = {"success_rate": F.round("success_rate", 6), "avg_seconds": F.round("avg_seconds", 4), "avg_size": F.round("avg_size", 4), "median_seconds": F.round("median_seconds", 4), "p90_seconds": F.round("p90_seconds", 4)}
    return m.report_summary(_reports(t), ["arch", "platform"]).withColumns(rounded)


@query("failure_top", "SELECT exception, count(*) AS n FROM report_rows WHERE NOT is_successful GROUP BY ALL ORDER BY n DESC, exception LIMIT 3")
def failure_top(t):
    return m.failure_top(_reports(t), 3)


@query("duplicate_nodes", "SELECT l_orderkey AS func_id, l_linenumber AS node, count(DISTINCT idx) AS n FROM line_rows GROUP BY ALL HAVING count(DISTINCT idx) > 1")
def duplicate_nodes(t):
    """Line numbers that an order holds more than once."""
    return m.duplicate_nodes(t.line_rows.select(F.col("l_orderkey").alias("func_id"), F.col("l_linenumber").alias("node"), "idx"))


@query("case_groups", """SELECT l_orderkey AS func_id, l_returnflag AS expr, count(*) AS n_cases, count(DISTINCT l_linenumber) AS n_conditions
    FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def case_groups(t):
    return m.case_groups(t.lineitem.select(F.col("l_orderkey").alias("func_id"), F.col("l_returnflag").alias("expr"), F.col("l_linenumber").alias("constant")))


@query("invert_map", """SELECT func_id, target, row_number() OVER (PARTITION BY func_id, target ORDER BY value) AS ord, value FROM
    (SELECT DISTINCT CAST(0 AS BIGINT) AS func_id, o_custkey AS target, o_orderkey AS value FROM orders)""")
def invert_map(t):
    """Which orders lead to a customer."""
    return m.invert_map(t.orders.select(F.lit(0).cast("bigint").alias("func_id"), F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("value")))


@query("extents", """SELECT p_brand, p_partkey, p_partkey * 16 AS address, 40000000 AS "end",
    coalesce(lead(p_partkey * 16) OVER (PARTITION BY p_brand ORDER BY p_partkey), 40000000) - p_partkey * 16 AS extent FROM part""")
def extents(t):
    items = t.part.select("p_brand", "p_partkey", (F.col("p_partkey") * 16).alias("address"), F.lit(40_000_000).alias("end"))
    return m.extents(items, ["p_brand"])


@query("counter_names", """SELECT func_id, idx, kind AS prefix, def_var AS identifier,
    kind || def_var || (row_number() OVER (PARTITION BY func_id, kind, def_var ORDER BY idx) - 1) AS label FROM flow_instr""")
def counter_names(t):
    return m.counter_names(t.flow_instr.select("func_id", "idx", F.col("kind").alias("prefix"), F.col("def_var").alias("identifier")), ["idx"])


@query("earliest_version", "SELECT func_id, name, arg_min(var, ver) AS var FROM ssa_uses GROUP BY ALL")
def earliest_version(t):
    return m.earliest_version(t.ssa_uses)


@query("insertion_index", """p AS (SELECT func_id, block, idx, kind, form, row_number() OVER (PARTITION BY func_id, block ORDER BY idx) - 1 AS position FROM flow_instr),
    b AS (SELECT func_id, block, count(*) AS n_rows, arg_max(kind, idx) AS last_kind, min(position) FILTER (WHERE form = 'operation') AS first FROM p GROUP BY ALL)
    SELECT func_id, block, coalesce(first, CASE WHEN last_kind = 'branch' THEN n_rows - 1 ELSE n_rows END) AS position FROM b""")
def insertion_index(t):
    rows = keep(Ordered(t.flow_instr.select("func_id", "block", "idx", "kind", "form"), ["func_id", "block"], ["idx"]).row_number("pos"))
    blocks = rows.groupBy("func_id", "block").agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("kind", "idx").alias("last_kind"))
    return m.insertion_index(blocks, rows.filter("form = 'operation'").select("func_id", "block", (F.col("pos") - 1).alias("position")))


@query("unique_names", """SELECT p_brand, p_partkey, p_name AS name, CASE WHEN r = 1 THEN p_name ELSE p_name || '__' || r END AS unique_name FROM
    (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part)""")
def unique_names(t):
    return m.unique_names(t.part.select("p_brand", "p_partkey", F.col("p_name").alias("name")), "p_brand", ["p_partkey"])


@query("unique_by_address", """SELECT p_partkey AS address, p_name AS name, CASE WHEN r = 1 THEN p_name ELSE p_name || '_' || lower(to_hex(p_partkey)) END AS unique_name
    FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)""")
def unique_by_address(t):
    return m.unique_by_address(t.part.select(F.col("p_partkey").alias("address"), F.col("p_name").alias("name")), ["address"])


@query("event_succession", "SELECT func_id, src, dst, count(*) AS n FROM flow_steps GROUP BY ALL")
def event_succession(t):
    return t.flow_steps.groupBy("func_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("top_complex", """SELECT func_id, idx, complexity, rank FROM (SELECT func_id, idx, complexity,
    CAST(row_number() OVER (PARTITION BY func_id ORDER BY complexity DESC, idx) AS INTEGER) AS rank FROM flow_instr) WHERE rank <= 3""")
def top_complex(t):
    """The three most complex rows of every function."""
    return m.top_k(t.flow_instr.select("func_id", "idx", "complexity"), ["func_id"], [F.desc("complexity"), F.col("idx")], 3)


@query("ordered_cases", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL ORDER BY p_brand, p_type")
def ordered_cases(t):
    return t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).orderBy("p_brand", "p_type")


@query("used_or_defined", """u AS (SELECT DISTINCT func_id, use_var AS var FROM flow_instr), d AS (SELECT DISTINCT func_id, def_var AS var FROM flow_instr)
    SELECT func_id, var, 'used only' AS part FROM (SELECT * FROM u EXCEPT SELECT * FROM d) UNION ALL
    SELECT func_id, var, 'either' FROM (SELECT * FROM u UNION SELECT * FROM d)""")
def used_or_defined(t):
    used, made = t.flow_instr.select("func_id", F.col("use_var").alias("var")), t.flow_instr.select("func_id", F.col("def_var").alias("var"))
    only = used.subtract(made).withColumn("part", F.lit("used only"))
    return only.unionByName(used.unionByName(made).distinct().withColumn("part", F.lit("either")))


@query("all_equal", "SELECT o_custkey, count(DISTINCT o_orderstatus) <= 1 AS all_equal FROM orders GROUP BY ALL")
def all_equal(t):
    return m.all_equal(t.orders, ["o_custkey"], "o_orderstatus")


@query("edges_with", """SELECT e.func_id, e.src, e.dst FROM flow_edges e WHERE EXISTS (SELECT 1 FROM flow_steps s JOIN flow_instr i
    ON i.func_id = s.func_id AND i.idx = s.idx WHERE s.func_id = e.func_id AND s.src = e.src AND s.dst = e.dst AND i.def_var = 'v3')""")
def edges_with(t):
    """Steps whose arrival ever wrote v3."""
    parts = t.flow_steps.join(t.flow_instr.select("func_id", "idx", F.col("def_var").alias("item")), ["func_id", "idx"]).select("func_id", "src", "dst", "item")
    wanted = t.flow_instr.select("func_id", F.lit("v3").alias("item")).distinct()
    return m.edges_with(t.flow_edges, parts, wanted)


@query("member_at", """m AS (SELECT p_size AS type_id, CAST(p_partkey % 64 AS INTEGER) AS "offset", min(p_name) AS member FROM part GROUP BY ALL),
    a AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS type_id, CAST(l_suppkey % 64 AS INTEGER) AS "offset" FROM lineitem)
    SELECT a.type_id, a."offset", coalesce(m.member, 'field_0x' || lower(to_hex(a."offset"))) AS member FROM a LEFT JOIN m USING (type_id, "offset")""")
def member_at(t):
    members = t.part.groupBy(F.col("p_size").alias("type_id"), (F.col("p_partkey") % 64).cast("int").alias("offset")).agg(F.min("p_name").alias("member"))
    asked = t.lineitem.select(F.col("l_quantity").cast("int").alias("type_id"), (F.col("l_suppkey") % 64).cast("int").alias("offset")).distinct()
    return m.member_at(members, asked)


@query("member_by_type", """a AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS type_id, CASE WHEN l_tax > 0.04 THEN 'PROMO' ELSE 'SMALL' END AS type FROM lineitem),
    f AS (SELECT p_size AS type_id, p_type AS type, arg_min(p_name, (p_partkey, p_name)) AS member FROM part GROUP BY ALL)
    SELECT a.type_id, a.type, coalesce(f.member, 'unknown_field') AS member FROM a LEFT JOIN f USING (type_id, type)""")
def member_by_type(t):
    members = t.part.select(F.col("p_size").alias("type_id"), F.col("p_partkey").alias("offset"), F.col("p_name").alias("member"), F.col("p_type").alias("type"))
    asked = t.lineitem.select(
        F.col("l_quantity").cast("int").alias("type_id"), F.when(F.col("l_tax") > 0.04, "PROMO").otherwise("SMALL").alias("type")
    ).distinct()
    return m.member_by_type(members, asked)


@query("enum_name", """m AS (SELECT p_size AS type_id, p_partkey AS value, p_name AS member FROM part), a AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS type_id, l_partkey AS value FROM lineitem)
    SELECT a.type_id, a.value, m.member FROM a LEFT JOIN m USING (type_id, value)""")
def enum_name(t):
    members = t.part.select(F.col("p_size").alias("type_id"), F.col("p_partkey").alias("offset"), F.col("p_name").alias("member"))
    return m.enum_name(members, t.lineitem.select(F.col("l_quantity").cast("int").alias("type_id"), F.col("l_partkey").alias("value")).distinct())


FOLDED = ("plus", "minus", "multiply", "divide", "modulo", "left_shift", "bitwise_xor")


@query("fold_constants", """r AS (SELECT l_orderkey, idx, l_linenumber % 7 AS op, CAST(l_partkey - 900 AS HUGEINT) * 1500007 % 2147483648 AS a,
      CAST(l_suppkey + 1 AS HUGEINT) * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS b FROM line_rows),
    v AS (SELECT l_orderkey, idx, op, CASE op WHEN 0 THEN a + b WHEN 1 THEN a - b WHEN 2 THEN a * b
      WHEN 3 THEN (a - ((a % b) + b) % b) // b WHEN 4 THEN CASE WHEN a < 0 THEN -1 ELSE 1 END * (((a % b) + b) % b)
      WHEN 5 THEN CASE WHEN b < 0 THEN NULL WHEN b >= 32 THEN 0 ELSE a * CAST(pow(2, b) AS HUGEINT) END
      ELSE CAST(xor(CAST(a AS BIGINT), CAST(b AS BIGINT)) AS HUGEINT) END AS v FROM r),
    w AS (SELECT *, ((v % 4294967296) + 4294967296) % 4294967296 AS u FROM v)
    SELECT l_orderkey, idx, CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS BIGINT) AS value FROM w""")
def fold_constants(t):
    op = F.element_at(F.array(*map(F.lit, FOLDED)), F.col("l_linenumber") % 7 + 1)
    left = (F.col("l_partkey") - 900) * 1_500_007 % 2_147_483_648
    right = (F.col("l_suppkey") + 1) * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    rows = t.line_rows.select("l_orderkey", "idx", op.alias("op"), left.alias("lhs"), right.alias("rhs"))
    return s.fold_constants(rows, "op", "lhs", "rhs", "value").select("l_orderkey", "idx", "value")


@query("bit_positions", """SELECT l_orderkey, idx, unnest(list_filter(range(0, 63), lambda i: (l_partkey * 65537 + l_suppkey) // CAST(pow(2, i) AS BIGINT) % 2 = 1)) AS bit FROM line_rows""")
def bit_positions(t):
    mask = F.col("l_partkey") * 65537 + F.col("l_suppkey")
    bits = t.line_rows.select("l_orderkey", "idx", F.explode(s.bit_positions(mask)).alias("bit"))
    return bits.withColumn("bit", F.col("bit").cast("bigint"))


@query("clean_name", """SELECT p_partkey, CASE WHEN raw LIKE '??%' ESCAPE '!' AND starts_with(raw, '??') OR length(raw) > 64 THEN 'data_' || lower(to_hex(p_partkey))
    ELSE replace(replace(replace(replace(replace(raw, '''', ''), '"', ''), '`', ''), ' ', '_'), '.', '_') END AS name FROM
    (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '??' || p_name WHEN 1 THEN repeat(p_name, p_size % 13) ELSE '"' || p_name || '.' || p_type || '`' END AS raw FROM part)""")
def clean_name(t):
    size, name = F.col("p_size"), F.col("p_name")
    raw = F.when(size % 4 == 0, F.concat(F.lit("??"), name)).when(size % 4 == 1, F.expr("repeat(p_name, p_size % 13)")).otherwise(
        F.concat(F.lit('"'), name, F.lit("."), F.col("p_type"), F.lit("`"))
    )
    return t.part.select("p_partkey", s.clean_name(raw, F.col("p_partkey")).alias("name"))


# orders as expression trees: a sum over the lines, each line an operation on a variable and a constant or second variable
view("tree_line", """SELECT l_orderkey, idx, l_returnflag AS x, CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_linestatus END AS y, l_linenumber,
    CASE WHEN l_linenumber % 3 = 0 THEN 'call' ELSE 'multiply' END AS op FROM line_rows""")


def _order_trees(t):
    key, base = F.col("l_orderkey").alias("func_id"), F.col("idx") * 4
    none = F.lit(None)

    def node(n, parent, pos, op, var, value):
        return F.struct(
            n.cast("bigint").alias("node"), parent.cast("bigint").alias("parent"), pos.cast("int").alias("pos"), op.cast("string").alias("op"),
            var.cast("string").alias("var"), value.cast("decimal(38,0)").alias("value"),
        )

    second = F.when(F.col("l_linestatus") != "F", F.col("l_linestatus"))
    line = F.array(
        node(base, F.lit(0), F.col("idx"), F.when(F.col("l_linenumber") % 3 == 0, "call").otherwise("multiply"), none, none),
        node(base + 1, base, F.lit(0), none, F.col("l_returnflag"), none),
        node(base + 2, base, F.lit(1), none, second, F.when(second.isNull(), F.col("l_linenumber"))),
    )
    lines = t.line_rows.select(key, F.explode(line).alias("n")).select("func_id", "n.*")
    roots = t.lineitem.select(key).distinct().select("func_id", node(F.lit(0), none, F.lit(0), F.lit("plus"), none, none).alias("n")).select("func_id", "n.*")
    return keep(roots.unionByName(lines))


@query("complexity", """SELECT l_orderkey AS func_id, 0 AS node, 2 * count(*) AS complexity FROM line_rows GROUP BY ALL UNION ALL SELECT l_orderkey, idx * 4, 2 FROM line_rows
    UNION ALL SELECT l_orderkey, idx * 4 + 1, 1 FROM line_rows UNION ALL SELECT l_orderkey, idx * 4 + 2, 1 FROM line_rows""")
def complexity(t):
    return tr.complexity(_order_trees(t)).select("func_id", "node", "complexity")


@query("tree_fingerprint", """g AS (SELECT l_orderkey, string_agg(op || x || coalesce(y, CAST(l_linenumber AS VARCHAR)), ',' ORDER BY idx) AS shape FROM tree_line GROUP BY ALL)
    SELECT min(l_orderkey) AS first, count(*) AS n FROM g GROUP BY shape""")
def tree_fingerprint(t):
    """Orders of the same tree: the first of them and how many there are."""
    label = F.coalesce("op", "var", F.col("value").cast("string"))
    trees = tr.tree_fingerprint(_order_trees(t).withColumn("label", label))
    return trees.filter("parent IS NULL").groupBy("fp").agg(F.min("func_id").alias("first"), F.count(F.lit(1)).alias("n")).drop("fp")


@query("dependency_scores", """o AS (SELECT l_orderkey, count(*) FILTER (WHERE op <> 'call') AS ways FROM tree_line GROUP BY ALL),
    s AS (SELECT l_orderkey, x AS var, CASE WHEN y IS NULL THEN 1.0 ELSE 2.0 END AS split FROM tree_line WHERE op <> 'call' UNION ALL
      SELECT l_orderkey, y, 2.0 FROM tree_line WHERE op <> 'call' AND y IS NOT NULL)
    SELECT l_orderkey AS func_id, var, round(sum(0.9 / split * 0.9 / ways), 6) AS score FROM s JOIN o USING (l_orderkey) GROUP BY ALL""")
def dependency_scores(t):
    return tr.dependency_scores(_order_trees(t)).select("func_id", "var", F.round("score", 6).alias("score"))


# one small computation per order line: (x op2 c) op1 y, or y op1 (x op2 c); x and y variables, y sometimes a constant
view("calc", """SELECT l_orderkey, idx, CASE l_suppkey % 4 WHEN 0 THEN 'plus' WHEN 1 THEN 'minus' WHEN 2 THEN 'multiply' ELSE 'bitwise_or' END AS inner_op,
    CASE l_partkey % 3 WHEN 0 THEN 'plus' WHEN 1 THEN 'multiply' ELSE 'bitwise_xor' END AS outer_op, lower(l_returnflag) AS x, l_linenumber % 3 AS c,
    CASE WHEN l_linestatus = 'F' THEN 'y' END AS y, CAST(l_quantity AS BIGINT) % 3 AS d, l_linenumber % 2 = 0 AS turned FROM line_rows""")


@query("canonical_expressions", """a AS (SELECT *, CASE WHEN inner_op = 'minus' THEN 'plus' ELSE inner_op END AS iop, CASE WHEN inner_op = 'minus' THEN -c ELSE c END AS k FROM calc),
    i AS (SELECT *, CASE WHEN (iop IN ('plus', 'bitwise_or') AND k = 0) OR (iop = 'multiply' AND k = 1) THEN x WHEN iop = 'multiply' AND k = 0 THEN NULL
      ELSE iop || '(' || x || ',' || k || ')' END AS ip, (iop IN ('plus', 'bitwise_or') AND k = 0) OR (iop = 'multiply' AND k IN (0, 1)) AS bare FROM a),
    o AS (SELECT *, CASE
      WHEN ip IS NULL AND y IS NULL THEN CAST(CASE WHEN outer_op = 'multiply' THEN 0 ELSE d END AS VARCHAR)
      WHEN ip IS NULL THEN CASE WHEN outer_op = 'multiply' THEN '0' ELSE 'y' END
      WHEN y IS NULL AND outer_op = 'multiply' AND d = 0 THEN '0'
      WHEN y IS NULL AND ((outer_op = 'multiply' AND d = 1) OR (outer_op <> 'multiply' AND d = 0)) THEN ip
      WHEN y IS NULL AND NOT bare AND iop = outer_op THEN CASE WHEN iop = 'plus' AND k + d = 0 THEN x ELSE iop || '(' || x || ',' ||
        (CASE WHEN iop = 'plus' THEN k + d ELSE k * d END) || ')' END
      WHEN y IS NULL THEN outer_op || '(' || ip || ',' || d || ')'
      WHEN NOT bare AND iop = outer_op THEN iop || '(' || iop || '(' || CASE WHEN turned THEN 'y,' || x ELSE x || ',y' END || '),' || k || ')'
      ELSE outer_op || '(' || CASE WHEN turned THEN 'y,' || ip ELSE ip || ',y' END || ')' END AS print FROM i)
    SELECT l_orderkey, idx, print, sha256(print) AS fp FROM o""")
def canonical_expressions(t):
    turned = F.col("l_linenumber") % 2 == 0
    none = F.lit(None)

    def node(n, parent, pos, op, var, value):
        return F.struct(
            F.concat_ws(":", "idx", F.lit(n)).alias("node"), (F.concat_ws(":", "idx", F.lit(parent)) if parent is not None else none.cast("string")).alias("parent"),
            pos.cast("int").alias("pos"), op.cast("string").alias("op"), var.cast("string").alias("var"), value.cast("decimal(38,0)").alias("value"),
        )

    inner = F.element_at(F.array(*map(F.lit, ("plus", "minus", "multiply", "bitwise_or"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    outer = F.element_at(F.array(*map(F.lit, ("plus", "multiply", "bitwise_xor"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    y = F.when(F.col("l_linestatus") == "F", "y")
    parts = F.array(
        node("r", None, F.lit(0), outer, none, none),
        node("i", "r", F.when(turned, 1).otherwise(0), inner, none, none),
        node("y", "r", F.when(turned, 0).otherwise(1), none, y, F.when(y.isNull(), F.col("l_quantity").cast("bigint") % 3)),
        node("x", "i", F.lit(0), none, F.lower("l_returnflag"), none),
        node("c", "i", F.lit(1), none, none, F.col("l_linenumber") % 3),
    )
    nodes = t.line_rows.select(F.col("l_orderkey").alias("func_id"), parts.alias("nodes"))
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("func_id")).agg((F.count(F.lit(1)) * 5).alias("n"))
    done = tr.canonical_expressions(nodes, counts=counts, roots=True).filter("parent IS NULL")
    return done.select(F.col("func_id").alias("l_orderkey"), F.substring_index("node", ":", 1).cast("bigint").alias("idx"), "print", "fp")
