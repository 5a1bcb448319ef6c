"""Registered queries and the SQL that states what each must return.

The SQL views below are the ones ``sources/tables.py`` builds with DataFrames; a query's SQL gets those it names, in this order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BODIES: dict[str, str] = {}

VIEWS = {
    "ev": """SELECT *, CAST(props->>'$.k' AS INTEGER) AS k,
        user_id * 100 + CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 604800.0) AS BIGINT) AS func_id FROM events""",
    "flow_instr": """SELECT func_id, event_type || '#' || (k % 3) AS block,
        row_number() OVER (PARTITION BY func_id ORDER BY ts, event_id) AS idx, event_id, k, value,
        CASE WHEN k % 10 <= 5 THEN 'assignment' WHEN k % 10 = 6 THEN 'call' WHEN k % 10 = 7 THEN 'branch'
             WHEN k % 10 = 8 THEN 'relation' ELSE 'return' END AS kind,
        CASE k % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'operation' WHEN 2 THEN 'constant' ELSE 'address' END AS form,
        'v' || (k % 7) AS def_var, 'v' || (event_id % 7) AS use_var, k % 11 = 0 AS aliased, event_type AS type,
        k % 7 + 1 AS complexity FROM ev""",
    "flow_steps": """SELECT func_id, src, block AS dst, idx, k FROM (SELECT func_id, block, idx, k,
        lag(block) OVER (PARTITION BY func_id ORDER BY idx) AS src FROM flow_instr) WHERE src IS NOT NULL""",
    "flow_edges": "SELECT DISTINCT func_id, src, dst FROM flow_steps",
    "flow_roots": "SELECT func_id, block AS root FROM flow_instr WHERE idx = 1",
    "flow_blocks": "SELECT func_id, block, count(*) AS n_rows, max(idx) AS last_idx FROM flow_instr GROUP BY ALL",
    "ssa_defs": """SELECT func_id, block, idx, kind, form, aliased, type, complexity, k, def_var AS name, def_var || '#' || idx AS var
        FROM flow_instr""",
    "ssa_uses": """SELECT func_id, idx, block, name, ver, name || '#' || ver AS var FROM (SELECT func_id, idx, block, use_var AS name,
        coalesce((SELECT max(d.idx) FROM flow_instr d WHERE d.func_id = u.func_id AND d.def_var = u.use_var AND d.idx < u.idx), 0) AS ver
        FROM flow_instr u)""",
    "ssa_copies": """SELECT d.func_id, d.idx, d.var AS dst, u.var AS src FROM ssa_defs d JOIN ssa_uses u USING (func_id, idx)
        WHERE d.form = 'copy'""",
    "phi_args": """SELECT * EXCLUDE (c) FROM (SELECT e.func_id, e.dst AS block, d.def_var || '@' || e.dst AS var, e.src AS pred_block,
        d.def_var || '@' || e.src AS arg, d.def_var AS name, count(*) OVER (PARTITION BY e.func_id, e.dst, d.def_var) AS c
        FROM flow_edges e JOIN (SELECT DISTINCT func_id, block, def_var FROM flow_instr) d ON d.func_id = e.func_id AND d.block = e.src
        WHERE e.src <> e.dst) WHERE c > 1""",
    "page_links": """SELECT CAST(0 AS BIGINT) AS func_id, 'page:' || page_id AS src,
        unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst FROM pages""",
    "hier_edges": """SELECT CAST(0 AS BIGINT) AS func_id, 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation
        UNION ALL SELECT 0, 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
        UNION ALL SELECT 0, 'c:' || o_custkey, 'o:' || o_orderkey FROM orders""",
    "line_rows": """SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS idx FROM lineitem""",
    "doc_lines": """SELECT DISTINCT CAST(0 AS BIGINT) AS func_id, 'd' || doc_id AS src, 'l' || md5(line) AS dst
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''""",
}


def view(name: str, sql: str) -> None:
    """Make a further SQL view known to the statements of ``query``."""
    VIEWS[name] = sql


def _with_views(body: str) -> str:
    """``body`` behind the views it names, directly or through others, each after those it needs."""
    views: list[str] = []
    done: set[str] = set()

    def need(text: str) -> None:
        for name, sql in VIEWS.items():
            if name not in done and re.search(rf"\b{name}\b", text):
                done.add(name)
                need(sql)
                views.append(f"{name} AS ({sql})")

    need(body)
    body = body.strip()
    if not body.upper().startswith("SELECT"):
        views.append(body)
        body = ""
    return ("WITH RECURSIVE " + ",\n".join(views) + "\n" if views else "") + body


def statements() -> dict[str, str]:
    """The SQL of every query that has one."""
    return {name: _with_views(body) for name, body in BODIES.items()}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL: a SELECT, or further views followed by a SELECT."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            BODIES[name] = sql
        return fn

    return add
