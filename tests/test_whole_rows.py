"""No row, digit or bit is lost at the edges: nulls, 64-bit addresses and masks."""

from conftest import got
from pyspark.sql import functions as F

from tributary.functions import scalar
from tributary.operators import mining, ranges
from tributary.sources import corpus


def test_functions_without_name_or_type_are_listed(table):
    rows = [(1, "s", "main", "function"), (2, "s", None, "function"), (3, "s", "f", None), (4, "s", "_init", "function"), (5, "s", "g", corpus.IMPORTED), (6, "s", None, corpus.IMPORTED)]
    functions = table("func_id bigint, sample_id string, name string, symbol_type string", rows)
    assert got(corpus.list_functions(functions), "func_id") == {1, 2, 3}
    samples = table("sample_id string, name string, content binary", [("s", "s", bytearray(b"x"))])
    assert got(corpus.sample_info(samples, functions), "total", "analysable") == {(6, 3)}


def test_addresses_of_sixteen_digits(table):
    rows = [(1, "a", 0x1000000000000010), (2, "b", -1), (3, "c", 16), (4, "d", -(2**63))]
    functions = table("func_id bigint, name string, address bigint", rows)
    ids = table("id string", [("1000000000000010",), ("sub_1000000000000010",), ("0xffffffffffffffff",), ("8000000000000000",), ("10",), ("00000000000000000010",), ("11",), ("10000000000000000",)])
    found = got(corpus.resolve_functions(functions, ids), "id", "func_id")
    assert found == {("1000000000000010", 1), ("sub_1000000000000010", 1), ("0xffffffffffffffff", 2), ("8000000000000000", 4), ("10", 3), ("00000000000000000010", 3), ("11", None), ("10000000000000000", None)}


def test_sections_at_large_and_negative_addresses(table):
    sections = [("s", 2**60 + 5, 2**60 + 17, "read_only"), ("s", -40, -3, "code"), ("s", 2**62, 2**62 + 1, "code")]
    asked = [("s", 2**60 + i) for i in range(-20, 44)] + [("s", i) for i in range(-60, 10)] + [("s", 2**62 + i) for i in (-1, 0, 1)]
    out = ranges.in_section(table("sample_id string, address bigint", asked), table("sample_id string, start bigint, `end` bigint, semantics string", sections))
    inside = {a for _, a in asked if any(lo <= a < hi for _, lo, hi, _ in sections)}
    assert got(out.filter("in_section"), "address") == inside and out.count() == len(asked)
    assert got(out.filter("in_read_only"), "address") == {2**60 + i for i in range(5, 18)}


def test_all_bits(table):
    masks = [-1, 0, 5, -(2**63), 2**62]
    rows = table("m bigint", [(m,) for m in masks]).select("m", scalar.bit_positions(F.col("m")).alias("b")).collect()
    assert {r.m: r.b for r in rows} == {-1: list(range(64)), 0: [], 5: [0, 2], -(2**63): [63], 2**62: [62]}


def test_null_labels_are_labels(table):
    rows = table("func_id bigint, name string, ssa int, type string, ord int, aliased boolean", [(1, "x", None, "b", 2, True), (1, "x", None, "a", 1, False), (1, "x", 0, "c", 3, False), (1, None, 0, "d", 1, True), (None, None, 0, "e", 0, False)])
    assert got(mining.harmonize_type(rows), "func_id", "name", "ssa", "ord", "type") == {(1, "x", None, 2, "a"), (1, "x", None, 1, "a"), (1, "x", 0, 3, "c"), (1, None, 0, 1, "d"), (None, None, 0, 0, "e")}
    assert got(mining.harmonize_aliased(rows), "func_id", "name", "ord", "aliased") == {(1, "x", 2, True), (1, "x", 1, True), (1, "x", 3, True), (1, None, 1, True), (None, None, 0, False)}
    assert corpus.report_unsupported(table("func_id bigint, text string", [(None, "a"), (None, None), (2, "b")]), ["q"]).count() == 3
    marked = corpus.has_marker(table("t string", [("rustc",), (None,), ("x",)]), "t")
    assert got(marked, "t", "marked") == {("rustc", True), (None, False), ("x", False)}


def test_index_of_large_offsets(table):
    rows = [(1, "p", "mul", 8, 8), (1, "p", "const", 2**61 + 8, 8), (1, "p", "const", -16, 8)]
    out = mining.strided_access(table("func_id bigint, base string, cls string, value bigint, element bigint", rows))
    assert got(out.filter("cls = 'const'"), "index") == {2**58 + 1, -2}


def test_jumping_ends_on_cycles(table):
    from tributary.fixpoint import jump

    rows = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "t", "a"), (1, "x", "y"), (1, "y", "z"), (2, "p", "p")]
    out = {(g, n): p for g, n, p in got(jump(table("func_id bigint, node string, parent string", rows)), "func_id", "node", "parent")}
    assert out[1, "x"] == out[1, "y"] == "z" and out[2, "p"] == "p" and {out[1, n] for n in "abct"} <= set("abc")


def test_visits_need_one_root(table, edges):
    from tributary.operators import visits

    both = edges("a>b c>d").unionByName(edges("e>f", 2))
    roots = table("func_id bigint, root string", [(1, "a"), (1, "c")])
    want = {(1, "a", 0, 1), (1, "b", 1, 0)}
    assert got(visits.dfs_order(both, roots), "func_id", "node", "pre", "post") == want
    assert got(visits.dfs_order(both, roots, max_edges=0), "func_id", "node", "pre", "post") == want
