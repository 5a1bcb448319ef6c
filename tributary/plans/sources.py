"""Source, predicate, streaming and stage queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tributary import stages as st
from tributary.operators import predicates as p
from tributary.operators import ranges
from tributary.plans.registry import query, view
from tributary.sources import corpus as c
from tributary.streaming import report_feed as feed
from tributary.tables import keep, shared_folder


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"


@query("read_corpus", """j AS (SELECT func_id, block, max(idx) AS idx, arg_max(kind, idx) AS kind FROM flow_instr GROUP BY ALL),
    o AS (SELECT func_id, src AS block FROM flow_edges GROUP BY ALL HAVING count(*) = 1)
    SELECT 'blocks' AS name, count(*) AS n FROM flow_blocks UNION ALL SELECT 'edges', count(*) FROM flow_edges UNION ALL
    SELECT 'instr', (SELECT count(*) FROM flow_instr) - (SELECT count(*) FROM j JOIN o USING (func_id, block) WHERE kind = 'return')""")
def read_corpus(t):
    """Weeks written as a corpus and read back; returns stand for constant jumps."""
    path = _folder(t)
    kind = F.when(F.col("kind") == "return", "jump").otherwise(F.col("kind"))
    instr = t.flow_instr.withColumns({"kind": kind, "opcode": F.when(kind == "jump", "constant")})
    c.write_corpus({"blocks": t.flow_blocks, "edges": t.flow_edges, "instr": instr}, path)
    tables = c.read_corpus(t.spark, path, ("blocks", "edges", "instr"))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _part_functions(t):
    return t.part.select(
        F.col("p_partkey").alias("func_id"), F.col("p_brand").alias("sample_id"), F.col("p_name").alias("name"), (F.col("p_partkey") * 16).alias("address"),
        F.when(F.col("p_type") == "PROMO", c.IMPORTED).otherwise("FunctionSymbol").alias("symbol_type"),
    )


HELPERS = ("small ring", "red widget", "hot plate")


@query("list_functions", "SELECT p_partkey AS func_id, p_name AS name FROM part WHERE p_type <> 'PROMO' AND p_name NOT IN ('small ring', 'red widget', 'hot plate')")
def list_functions(t):
    return c.list_functions(_part_functions(t), HELPERS).select("func_id", "name")


@query("resolve_functions", """f AS (SELECT c_custkey AS func_id, c_name AS name, c_custkey * 16 + 4096 AS address FROM customer),
    i AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') WHEN 1 THEN lower(to_hex(o_custkey * 16 + 4096))
      WHEN 2 THEN 'sub_' || lower(to_hex(o_custkey * 16 + 4096)) ELSE 'loc_' || o_custkey END AS id FROM orders)
    SELECT i.o_orderkey, i.id, coalesce(n.func_id, a.func_id) AS func_id FROM i LEFT JOIN f n ON n.name = i.id
    LEFT JOIN f a ON lower(to_hex(a.address)) = regexp_replace(i.id, '^sub_', '')""")
def resolve_functions(t):
    functions = t.customer.select(F.col("c_custkey").alias("func_id"), F.col("c_name").alias("name"), (F.col("c_custkey") * 16 + 4096).alias("address"))
    key, digits = F.col("o_orderkey") % 4, F.lower(F.hex(F.col("o_custkey") * 16 + 4096))
    named = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    ident = F.when(key == 0, named).when(key == 1, digits).when(key == 2, F.concat(F.lit("sub_"), digits)).otherwise(F.concat(F.lit("loc_"), "o_custkey"))
    return c.resolve_functions(functions, t.orders.select("o_orderkey", ident.alias("id")))


@query("small_functions", "SELECT func_id, block FROM flow_blocks WHERE func_id IN (SELECT func_id FROM flow_blocks GROUP BY 1 HAVING count(*) <= 8)")
def small_functions(t):
    return c.small_functions(t.flow_blocks.select("func_id", "block"), 8)


@query("read_manifest", "SELECT 'nation_' || s_nationkey AS sample, s_name AS function FROM supplier")
def read_manifest(t):
    path = _folder(t)
    t.supplier.select(F.concat(F.lit("nation_"), "s_nationkey", F.lit(" \t"), "s_name", F.lit(" ")).alias("value")).write.text(path)
    return c.read_manifest(t.spark, path)


@query("scan_source", "SELECT 'test' || c_custkey AS name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def scan_source(t):
    path = _folder(t)
    name = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", " int check").otherwise("int test"), F.col("c_custkey").cast("string"))
    lines = F.concat(name, F.lit("(int a, char b) {\n  return test0(a);\n}"))
    t.customer.select(lines.alias("value")).write.text(path)
    return c.scan_source(t.spark, path).select("name")


@query("match_by_suffix", """SELECT c_name AS file, s.source FROM customer JOIN (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS source FROM supplier) s
    ON ends_with(c_name, s.source)""")
def match_by_suffix(t):
    return c.match_by_suffix(t.customer.select(F.col("c_name").alias("file")), t.supplier.select(F.col("s_suppkey").cast("string").alias("source")))


@query("sample_info", """SELECT 'doc' || doc_id AS sample_id, source AS sample_name, sha256(text) AS sample_hash,
    len(string_split(text, chr(10))) AS total, len(list_filter(string_split(text, chr(10)), lambda x: x NOT LIKE 'T%' AND length(x) > 20)) AS analysable
    FROM documents""")
def sample_info(t):
    """Documents as samples, their lines as functions; short lines stand for imported ones."""
    sample = F.concat(F.lit("doc"), "doc_id").alias("sample_id")
    lines = t.documents.select(sample, F.explode(F.split("text", "\n")).alias("line"))
    symbol = F.when(F.col("line").startswith("T") | (F.length("line") <= 20), c.IMPORTED).otherwise("FunctionSymbol")
    functions = lines.select("sample_id", F.col("line").alias("name"), symbol.alias("symbol_type"))
    return c.sample_info(t.documents.select(sample, F.col("source").alias("name"), F.encode("text", "UTF-8").alias("content")), functions)


@query("has_marker", "SELECT doc_id, text LIKE '%license%' OR text LIKE '%License%' OR text LIKE '%password%' AS marked FROM documents")
def has_marker(t):
    return c.has_marker(t.documents, "text", ["license", "License", "password"]).select("doc_id", "marked")


@query("classify_string", r"""SELECT doc_id, CASE WHEN ok THEN CAST(length(text) AS INTEGER) END AS n, CASE WHEN ok THEN CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END END AS width FROM
    (SELECT doc_id, text, regexp_full_match(text, '[\t\n\r\x20-\x7e]+') AND length(text) > 1 AS ok FROM documents)""")
def classify_string(t):
    """Documents as bytes, every second one in two bytes per character."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16LE"))
    out = c.classify_string(t.documents.select("doc_id", raw.alias("raw")), "raw")
    return out.select("doc_id", F.length("string").alias("n"), "width")


def _report_table(t):
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("sample_name"), (F.col("o_orderstatus") != "P").alias("is_successful"),
        F.col("o_totalprice").cast("int").alias("seconds"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


@query("append_reports", """SELECT c_mktsegment AS sample_name, 2 * count(*) AS n, count(DISTINCT o_orderkey) AS n_ids FROM orders
    JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def append_reports(t):
    """All reports appended twice."""
    path = _folder(t)
    reports = _report_table(t)
    c.append_reports(reports, path)
    c.append_reports(reports, path)
    back = t.spark.read.schema(reports.schema).parquet(path)
    return back.groupBy("sample_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


@query("report_unsupported", """r AS (SELECT func_id, idx, block AS text FROM flow_instr WHERE form = 'address'),
    n AS (SELECT func_id, count(*) AS n_unsupported FROM r GROUP BY ALL)
    SELECT r.func_id, r.idx, r.text, n.n_unsupported FROM r JOIN n USING (func_id) WHERE n_unsupported <= 3 OR text LIKE '%purchase%' OR text LIKE '%signup#1%'""")
def report_unsupported(t):
    rows = t.flow_instr.filter("form = 'address'").select("func_id", "idx", F.col("block").alias("text"))
    return c.report_unsupported(rows, ["purchase", "signup#1"])


view("dest_rows", """SELECT *, CASE WHEN k % 6 = 0 THEN 'dereference' WHEN k % 13 = 0 AND kind = 'call' THEN 'empty list' ELSE 'variable' END AS dest FROM flow_instr""")


def _dest(t):
    dest = F.when(F.col("k") % 6 == 0, "dereference").when((F.col("k") % 13 == 0) & (F.col("kind") == "call"), "empty list").otherwise("variable")
    return t.flow_instr.withColumn("dest", dest)


@query("is_sink", """SELECT func_id, idx, kind <> 'assignment' OR dest = 'dereference' AS sink,
    (kind <> 'assignment' OR dest = 'dereference') AND kind <> 'relation' AS graph_sink FROM dest_rows""")
def is_sink(t):
    return _dest(t).select("func_id", "idx", p.is_sink().alias("sink"), p.is_sink(False).alias("graph_sink"))


@query("is_definition", """SELECT func_id, idx, kind IN ('assignment', 'call') AND dest = 'variable' AS definition,
    kind = 'assignment' AND form = 'copy' AND dest = 'variable' AS copied FROM dest_rows""")
def is_definition(t):
    return _dest(t).select("func_id", "idx", p.is_definition().alias("definition"), p.is_copy().alias("copied"))


@query("can_propagate", """SELECT func_id, idx FROM dest_rows WHERE kind = 'assignment' AND dest = 'variable' AND form <> 'address' AND NOT aliased AND k % 17 <> 0
    AND NOT (form = 'operation' AND k % 5 = 0) AND NOT (form <> 'copy' AND k % 9 = 0)""")
def can_propagate(t):
    rows = _dest(t).withColumn("writeable_global", F.col("k") % 17 == 0)
    return rows.filter(p.can_propagate(F.col("k") % 5 == 0, F.col("k") % 9 == 0)).select("func_id", "idx")


@query("block_types", """SELECT func_id, block, CASE arg_max(kind, idx) WHEN 'branch' THEN 'conditional' ELSE 'direct' END AS ctl_type FROM flow_instr GROUP BY ALL""")
def block_types(t):
    return p.block_types(t.flow_instr)


view("kind_edges", """SELECT func_id, src, dst, CASE WHEN src LIKE 'view%' THEN CASE WHEN dst < src THEN 'true' ELSE 'false' END WHEN src LIKE 'click%' THEN 'switch'
    ELSE 'unconditional' END AS kind FROM flow_edges""")


def _kind_edges(t):
    kind = F.when(F.col("src").startswith("view"), F.when(F.col("dst") < F.col("src"), "true").otherwise("false")).when(
        F.col("src").startswith("click"), "switch"
    )
    return t.flow_edges.withColumn("kind", kind.otherwise("unconditional"))


@query("edge_conditions", """SELECT b.func_id, b.block AS node, coalesce(bool_and(e.kind IN ('true', 'false')), true) AS is_conditional,
    coalesce(bool_and(e.kind = 'switch'), true) AS is_switch FROM flow_blocks b LEFT JOIN kind_edges e ON e.func_id = b.func_id AND e.src = b.block GROUP BY ALL""")
def edge_conditions(t):
    return p.edge_conditions(t.flow_blocks.select("func_id", F.col("block").alias("node")), _kind_edges(t))


@query("noreturn_leaves", """SELECT b.func_id, b.block AS node FROM flow_blocks b ANTI JOIN flow_edges c ON c.func_id = b.func_id AND c.src = b.block
    SEMI JOIN (SELECT func_id, block FROM flow_instr WHERE kind = 'call' GROUP BY ALL HAVING count(*) = 1 AND NOT bool_or(k % 4 > 0)) i
      ON i.func_id = b.func_id AND i.block = b.block""")
def noreturn_leaves(t):
    """Last blocks with one call, whose callee (one in four) does not return."""
    calls = t.flow_instr.filter("kind = 'call'").select("func_id", F.col("block").alias("node"), (F.col("k") % 4 > 0).alias("can_return"))
    return p.noreturn_leaves(t.flow_blocks.select("func_id", F.col("block").alias("node")), t.flow_edges, calls)


@query("guard_leaves", """leaf AS (SELECT b.func_id, b.block FROM flow_blocks b ANTI JOIN flow_edges c ON c.func_id = b.func_id AND c.src = b.block)
    SELECT l.func_id, l.block AS node FROM leaf l WHERE EXISTS (SELECT 1 FROM flow_instr i WHERE i.func_id = l.func_id AND i.block = l.block AND i.k = 71)
      OR EXISTS (SELECT 1 FROM kind_edges e JOIN flow_blocks g ON g.func_id = e.func_id AND g.block = e.src JOIN flow_instr x ON x.func_id = g.func_id
        AND x.idx = g.last_idx WHERE e.func_id = l.func_id AND e.dst = l.block AND x.def_var IN ('v1', 'v2')
        AND ((x.k % 2 = 0 AND e.kind = 'false') OR (x.k % 2 = 1 AND e.kind = 'true')))""")
def guard_leaves(t):
    nodes = t.flow_blocks.select("func_id", F.col("block").alias("node"))
    texts = t.flow_instr.select("func_id", F.col("block").alias("node"), F.concat(F.lit("<"), "k", F.lit(">")).alias("text"))
    last = t.flow_blocks.select("func_id", "block", F.col("last_idx").alias("idx")).join(t.flow_instr, ["func_id", "block", "idx"])
    guarded = last.select(
        "func_id", F.col("block").alias("src"), F.when(F.col("k") % 2 == 0, "equal").otherwise("not_equal").alias("op"), F.col("def_var").isin("v1", "v2").alias("operand_fits")
    )
    return p.guard_leaves(nodes, _kind_edges(t), texts, "<71>", guarded)


@query("over_complexity", """SELECT func_id, idx FROM flow_instr WHERE complexity > CASE kind WHEN 'assignment' THEN 4 WHEN 'call' THEN 1 WHEN 'return' THEN 3 END""")
def over_complexity(t):
    return p.over_complexity(t.flow_instr, {"assignment": 4, "call": 0, "return": 3}).select("func_id", "idx")


@query("contract_empty", """hop AS (SELECT e.func_id, e.src AS node, min(e.dst) AS parent FROM flow_edges e WHERE e.src LIKE '%#1' GROUP BY ALL
      HAVING count(DISTINCT e.dst) = 1 AND min(e.dst) <> e.src),
    fine AS (SELECT h.func_id, h.parent AS node FROM hop h ANTI JOIN hop g ON g.func_id = h.func_id AND g.node = h.parent UNION
      SELECT h.func_id, h.node FROM fine f JOIN hop h ON h.func_id = f.func_id AND h.parent = f.node),
    ok AS (SELECT h.* FROM hop h SEMI JOIN fine f ON f.func_id = h.func_id AND f.node = h.node),
    w AS (SELECT func_id, node, parent, 1 AS d FROM ok UNION ALL SELECT w.func_id, w.node, o.parent, d + 1 FROM w JOIN ok o ON o.func_id = w.func_id AND o.node = w.parent),
    r AS (SELECT func_id, node, arg_max(parent, d) AS last FROM w GROUP BY ALL),
    e AS (SELECT k.func_id, k.src, coalesce(r.last, k.dst) AS dst, k.kind, CASE WHEN k.kind = 'switch' THEN ascii(k.dst) END AS c FROM kind_edges k
      LEFT JOIN r ON r.func_id = k.func_id AND r.node = k.dst ANTI JOIN ok x ON x.func_id = k.func_id AND x.node = k.src)
    SELECT func_id, src, dst, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'unconditional' END AS kind,
      coalesce(array_to_string(list_sort(list(DISTINCT c) FILTER (WHERE c IS NOT NULL)), ','), '') AS cases, count(*) AS n FROM e GROUP BY ALL""")
def contract_empty(t):
    """Steps without the blocks numbered 1, as far as these lead to one block only."""
    edges = _kind_edges(t).withColumn("cases", F.when(F.col("kind") == "switch", F.array(F.ascii("dst").cast("bigint"))))
    empty = t.flow_blocks.filter("block LIKE '%#1'").select("func_id", F.col("block").alias("node"))
    return p.contract_empty(edges, empty).withColumn("cases", F.array_join("cases", ","))


@query("in_section", """s AS (SELECT s_nationkey AS sample_id, CAST(floor(s_acctbal) AS BIGINT) + 2000 AS "start", CAST(floor(s_acctbal) AS BIGINT) + 2000 + 300 + s_suppkey % 7 * 200 AS "end",
      s_suppkey % 2 = 0 AS ro FROM supplier), a AS (SELECT DISTINCT c_nationkey AS sample_id, CAST(floor(c_acctbal) AS BIGINT) + 2000 AS address FROM customer)
    SELECT a.sample_id, a.address, EXISTS (SELECT 1 FROM s WHERE s.sample_id = a.sample_id AND a.address >= s."start" AND a.address < s."end") AS in_section,
      EXISTS (SELECT 1 FROM s WHERE s.sample_id = a.sample_id AND a.address BETWEEN s."start" AND s."end" AND s.ro) AS in_read_only FROM a""")
def in_section(t):
    """Which customer balances lie in a range around a supplier's balance of the same nation."""
    start = F.floor("s_acctbal") + 2000
    sections = t.supplier.select(
        F.col("s_nationkey").alias("sample_id"), start.alias("start"), (start + 300 + F.col("s_suppkey") % 7 * 200).alias("end"),
        F.when(F.col("s_suppkey") % 2 == 0, "read_only").otherwise("writable").alias("semantics"),
    )
    return ranges.in_section(t.customer.select(F.col("c_nationkey").alias("sample_id"), (F.floor("c_acctbal") + 2000).alias("address")), sections)


@query("report_feed", "SELECT c_mktsegment AS sample_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def report_feed(t):
    """Reports that arrive in two batches of files, appended as a stream."""
    path = _folder(t)
    reports = _report_table(t)
    c.append_reports(reports.filter("is_successful"), f"{path}/in")
    for rest in (None, reports.filter("NOT is_successful")):
        if rest is not None:
            c.append_reports(rest, f"{path}/in")
        feed.append_feed(feed.read_feed(t.spark, reports.schema, f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").groupBy("sample_name").agg(F.count(F.lit(1)).alias("n"))


@query("running_failures", """SELECT CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) // 864000 AS period, c_mktsegment AS sample_name, count(*) AS n,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS n_failed FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def running_failures(t):
    """Failures per sample and ten days, counted as a stream; a late last row closes all windows."""
    path = _folder(t)
    reports = _report_table(t)
    end = reports.agg(*[F.max(name).alias(name) for name in reports.columns]).withColumn("timestamp", F.expr("timestamp'2100-01-01 00:00:00'"))
    c.append_reports(reports, f"{path}/in")
    for more in (None, end):
        if more is not None:
            c.append_reports(more, f"{path}/in")
        counted = feed.failures_per_window(feed.read_feed(t.spark, reports.schema, f"{path}/in"), "10 days")
        feed.append_feed(counted, f"{path}/out", f"{path}/state").awaitTermination()
    out = t.spark.read.parquet(f"{path}/out")
    period = F.floor(F.unix_timestamp("window_start") / 864_000)
    return out.select(period.alias("period"), "sample_name", "n", "n_failed")


@query("staged_run", """f AS (SELECT func_id, count(*) AS blocks FROM flow_blocks GROUP BY ALL), s AS (SELECT DISTINCT func_id FROM flow_edges WHERE src = dst),
    e AS (SELECT func_id, count(*) AS n FROM flow_edges GROUP BY ALL)
    SELECT f.func_id, CASE WHEN blocks > 11 THEN 'size' WHEN s.func_id IS NOT NULL THEN 'loops' END AS failure_origin,
      CASE WHEN blocks <= 11 AND s.func_id IS NULL THEN e.n END AS n_edges FROM f LEFT JOIN s USING (func_id) LEFT JOIN e USING (func_id)""")
def staged_run(t):
    """Two stages: too many blocks fail the first, a step onto itself the second; edges of what is left."""

    def size(corpus):
        big = corpus["blocks"].groupBy("func_id").count().filter("count > 11")
        return corpus, big.select("func_id", F.lit("too many blocks").alias("reason"))

    def loops(corpus):
        return corpus, corpus["edges"].filter("src = dst").select("func_id", F.lit("step onto itself").alias("reason")).distinct()

    known = {"size": st.Stage("size", size), "loops": st.Stage("loops", loops, ("size",))}
    functions = t.flow_blocks.select("func_id").distinct()
    corpus, done = st.run_stages({"blocks": t.flow_blocks, "edges": t.flow_edges}, functions, st.choose(["size", "loops"], known))
    edges = corpus["edges"].groupBy("func_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return done.select("func_id", "failure_origin").join(edges, "func_id", "left")
