"""Data-flow, value and expression operators on hand fixtures and against brute force."""

import random

import pytest
from conftest import got
from pyspark.sql import functions as F

from tributary.functions.ordered import Ordered
from tributary.functions.scalar import fold_constants, printable_string
from tributary.operators import dataflow as f
from tributary.operators import mining as m
from tributary.operators import trees as tr
from tributary.operators import values as v
from tributary.operators import versions as ver
from tributary.operators.ranges import points_in_intervals

ROWS = "func_id bigint, block string, idx int, var string"


def test_reaching_definitions_in_one_block(edges, table):
    defs = table(ROWS, [(1, "b", 0, "a"), (1, "b", 1, "a"), (1, "b", 3, "c")])
    e = edges("x>b").limit(0)
    reach_in = f.reaching_defs(e, defs)
    assert not got(reach_in, "def_idx")
    assert got(f.reaching_out(e, defs, reach_in), "def_idx") == {1, 3}
    after = f.asof_def(defs, table(ROWS, [(1, "b", i, "a") for i in range(4)]))
    assert got(after, "idx", "def_idx") == {(0, 0), (1, 1), (2, 1), (3, 1)}


def test_reaching_definitions_in_a_loop(edges, table):
    e = edges("n0>n1 n1>n2 n2>n1 n1>n3")
    defs = table(ROWS, [(1, "n0", 0, "a"), (1, "n2", 3, "a")])
    reach_in = f.reaching_defs(e, defs)
    assert got(reach_in, "block", "def_idx") == {(b, i) for b in ("n1", "n2", "n3") for i in (0, 3)}
    assert {i for b, i in got(f.reaching_out(e, defs, reach_in), "block", "def_idx") if b == "n2"} == {3}
    assert got(f.reaching_uses(e, defs, table(ROWS, [(1, "n2", 2, "a")])), "def_idx") == {0, 3}


def test_points_to_over_a_merge(table):
    seeds = table("func_id bigint, ptr string, target string", [(1, "ptr0", "x"), (1, "ptr1", "y")])
    copies = table("func_id bigint, src string, dst string", [(1, "ptr0", "ptr2"), (1, "ptr1", "ptr2")])
    assert got(ver.points_to(seeds, copies), "ptr", "target") == {("ptr0", "x"), ("ptr1", "y"), ("ptr2", "x"), ("ptr2", "y")}


FOLDS = [
    ("plus", 3, 4, 32, True, 7),
    ("plus", 2147483647, 1, 32, True, -2147483648),
    ("plus", 2147483658, 2147483652, 32, False, 14),
    ("minus", 3, 4, 32, False, 4294967295),
    ("multiply", -1073741824, 2, 32, True, -2147483648),
    ("multiply_us", 4294967295, 4294967295, 32, False, 1),
    ("multiply_us", 2**64 - 1, 2**64 - 1, 64, False, 1),
    ("multiply", -(2**62), 2, 64, True, -(2**63)),
    ("divide", -7, 2, 32, True, -4),
    ("divide_us", -7, 2, 32, False, 2147483644),
    ("modulo", -7, 3, 32, True, -2),
    ("modulo", 7, -3, 32, True, -2),
    ("modulo_us", 7, 4, 32, False, 3),
    ("left_shift", 3, 31, 32, True, -2147483648),
    ("left_shift", 1, 63, 64, False, 2**63),
    ("left_shift", 1, 40, 32, True, 0),
    ("right_shift", -8, 1, 32, True, -4),
    ("right_shift_us", -8, 1, 32, True, 2147483644),
    ("right_shift_us", 2**64 - 1, 63, 64, False, 1),
    ("bitwise_xor", -1, 5, 32, True, -6),
    ("bitwise_not", 0, 0, 32, False, 4294967295),
    ("negate", -2147483648, 0, 32, True, -2147483648),
    ("divide", 1, 0, 32, True, None),
    ("power", 1, 0, 32, True, None),
]


@pytest.mark.parametrize("size,signed", [(32, True), (32, False), (64, True), (64, False)])
def test_constant_folding(table, size, signed):
    cases = [c for c in FOLDS if c[3:5] == (size, signed)]
    rows = [(i, op, a, b) for i, (op, a, b, *_) in enumerate(cases)]
    df = table("i int, op string, a decimal(38,0), b decimal(38,0)", [(i, op, __import__("decimal").Decimal(a), __import__("decimal").Decimal(b)) for i, op, a, b in rows])
    out = got(fold_constants(df, "op", "a", "b", "value", size, signed), "i", "value")
    assert {(i, None if x is None else int(x)) for i, x in out} == {(i, c[5]) for i, c in enumerate(cases)}


def test_folding_rejects_mixed_sizes(table):
    df = table("op string, a bigint, b bigint", [("plus", 1, 2), ("left_shift", 1, 2)])
    assert got(fold_constants(df, "op", "a", "b", "value", right_size=16), "op", "value") == {("plus", None), ("left_shift", 4)}


def test_strided_access_without_constants(table):
    rows = table("func_id bigint, base string, cls string, value bigint, element int", [(1, "arg1", "mul", 4, 4), (1, "q", "mul", 4, 8), (1, "r", "const", 4, 0)])
    out = m.strided_access(rows)
    assert got(out, "base", "stride", "confident") == {("arg1", 4, True)}


def test_printable_strings(table):
    cases = {b"abc\0\xff": ("abc", 1), b"a\0b\0\0\0": ("ab", 2), b"\t": ("\t", 1), b"a": None, b"a\0\0\0b\0\0\0": ("ab", 4), b"a\x01b": None, b"": None, b"\x7fab": None}
    out = table("raw binary", [(bytearray(k),) for k in cases]).withColumn("s", printable_string(F.col("raw")))
    assert {bytes(r.raw): None if r.s is None else (r.s.text, r.s.width) for r in out.collect()} == cases


@pytest.mark.parametrize("max_rows", [10_000, 7])
def test_large_groups_are_split(table, max_rows):
    rnd = random.Random(1)
    rows = [(1 if i % 3 else i % 20, i, rnd.choice([None, i])) for i in range(300)]
    df = table("key int, at int, value int", rows)
    o = Ordered(df, ["key"], ["at"], max_rows)
    assert o.split == (max_rows == 7)
    groups = {}
    for k, at, x in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append((at, x))
    number = {(k, at, i + 1) for k, part in groups.items() for i, (at, _) in enumerate(part)}
    assert got(o.row_number("n"), "key", "at", "n") == number
    before = {(k, at, part[i - 1][0] if i else None) for k, part in groups.items() for i, (at, _) in enumerate(part)}
    assert got(o.previous("at", "p"), "key", "at", "p") == before

    def last(part, i):
        return next((x for _, x in reversed(part[:i]) if x is not None), None)

    for inclusive in (False, True):
        want = {(k, at, last(part, i + inclusive)) for k, part in groups.items() for i, (at, _) in enumerate(part)}
        assert got(o.last_known(F.col("value"), "l", inclusive), "key", "at", "l") == want


def test_points_in_intervals_by_brute_force(table):
    rnd = random.Random(2)
    points = [(k, rnd.randrange(500)) for k in range(3) for _ in range(60)]
    spans = [(k, i, lo, lo + rnd.randrange(300)) for k in range(3) for i in range(60) for lo in [rnd.randrange(500)]]
    out = points_in_intervals(table("k int, at int", points), table("k int, i int, lo int, hi int", spans), ["k"], "at", "lo", "hi")
    want = sorted((k, at, i) for k, at in points for k2, i, lo, hi in spans if k == k2 and lo <= at < hi)
    assert sorted(tuple(r) for r in out.select("k", "at", "i").collect()) == want


def test_identities(edges, table):
    # p merges x and y, which differ; q merges p and a copy of p; s merges z over two ways
    e = edges("p>x p>y q>p q>c c>p s>t s>z t>z")
    phis = table("func_id bigint, node string", [(1, n) for n in "pqs"])
    defined = table("func_id bigint, node string", [(1, n) for n in "xyz"])
    out = got(v.identity_groups(e, phis, defined), "node", "grp", "representative")
    assert out == {(n, "c", "p") for n in "pqc"} | {(n, "s", "z") for n in "stz"}


def test_identity_conflicts(edges, table):
    # undefined leaves count once a conflict ties the component together
    e = edges("p>x p>u")
    phis, defined = table("func_id bigint, node string", [(1, "p")]), table("func_id bigint, node string", [(1, "x")])
    assert got(v.identity_groups(e, phis, defined), "node") == {"p", "x", "u"}
    clash = table("func_id bigint, a string, b string", [(1, "x", "u")])
    assert got(v.identity_groups(e, phis, defined, clash), "node") == set()


def test_merging_by_score(table):
    scores = table("func_id bigint, a string, b string, score bigint", [(1, "a", "b", 5), (1, "b", "c", 4), (1, "c", "d", 3), (1, "a", "d", 1)])
    conflicts = table("func_id bigint, a string, b string", [(1, "a", "c")])
    names = table("func_id bigint, node string", [(1, n) for n in "abcde"])
    out = got(v.merge_by_score(scores, conflicts, names), "node", "grp")
    assert out == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")}


def test_colouring_is_first_fit(table):
    rnd = random.Random(3)
    names = [f"n{i:02}" for i in range(24)]
    pairs = {tuple(sorted(rnd.sample(names, 2))) for _ in range(70)}
    cls = {n: "xy"[i % 5 == 0] for i, n in enumerate(names)}
    out = dict(got(v.color_groups(table("func_id bigint, node string, cls string", [(1, n, cls[n]) for n in names]), table("func_id bigint, a string, b string", [(1, *p) for p in pairs])), "node", "color"))
    near = {n: {a if b == n else b for a, b in pairs if n in (a, b) and cls[a] == cls[b]} for n in names}
    want = {}
    for n in sorted(names, key=lambda x: (-len(near[x]), x)):
        want[n] = next(c for c in range(99) if all(want.get(o) != c for o in near[n]))
    assert out == want


def test_trivial_merges(table):
    rows = [("A", "a", "x"), ("A", "a", "x"), ("A", "b", "b"), ("A", "c", "d"), ("A", "d", "y"), ("A", "d", "z"), ("A", "e", "a"), ("A", "f", "g"), ("A", "g", "f"), ("A", "h", "b")]
    # merged in another block and kept there: no dependency
    rows += [("B", "t", "d"), ("B", "t", "d")]
    args = table("func_id bigint, block string, var string, arg string", [(1, *r) for r in rows])
    assert got(ver.trivial_phis(args), "block", "var", "value", "action") == {
        ("A", "a", "x", "copy"), ("A", "b", "b", "drop"), ("A", "e", "a", "copy"), ("A", "h", "b", "copy"), ("B", "t", "d", "copy")
    }
    assert got(ver.phi_deps(args), "block", "src", "dst") == {("A", "c", "d"), ("A", "e", "a"), ("A", "f", "g"), ("A", "g", "f"), ("A", "h", "b")}
    assert got(ver.phi_cycles(args), "block", "var") == {("A", "f"), ("A", "g")}


def test_majority(table):
    rows = [("g", t) for t in ["int", "int", "int", "foo", "bar", "Unknown"]] + [("h", "Unknown"), ("i", "int"), ("i", "void *")]
    out = v.majority_type(table("g string, type string", rows), ["g"], F.col("type").isin("int", "void *"))
    assert got(out, "g", "type") == {("g", "foo"), ("h", "Unknown"), ("i", "void *")}


def test_canonical_expressions(table):
    schema = "func_id bigint, node string, parent string, pos int, op string, var string, value decimal(38,0)"
    count = 0

    def tree(expr, parent=None, pos=0):
        nonlocal count
        count += 1
        name = str(count)
        if not isinstance(expr, tuple):
            return [(1, name, parent, pos, None, expr if isinstance(expr, str) else None, __import__("decimal").Decimal(expr) if isinstance(expr, int) else None)]
        rows = [(1, name, parent, pos, expr[0], None, None)]
        for i, part in enumerate(expr[1:]):
            rows += tree(part, name, i)
        return rows

    cases = {
        ("plus", 3, "a"): "plus(a,3)",
        ("minus", "a", 0): "a",
        ("minus", 0, "a"): "negate(a)",
        ("minus", "a", ("negate", "b")): "plus(a,b)",
        ("plus", ("plus", "a", 3), ("minus", "b", 5)): "plus(plus(a,b),-2)",
        ("multiply", ("multiply", 2, "a"), 4): "multiply(a,8)",
        ("multiply", "a", 0): "0",
        ("bitwise_xor", ("plus", "a", 1), ("plus", 1, "a")): "0",
        ("bitwise_and", "a", "a"): "a",
        ("left_shift", "a", 0): "a",
        ("dereference", ("address", ("plus", "a", "b"))): "plus(a,b)",
        ("logical_or", "a", 1): "1",
        ("negate", ("negate", "a")): "a",
        ("divide", "a", 1): "a",
        ("less", 1, "a"): "less(1,a)",
    }
    rows, roots = [], {}
    for expr in cases:
        part = tree(expr)
        roots[part[0][1]] = expr
        rows += part
    out = got(tr.canonical_expressions(table(schema, rows)).filter("parent IS NULL"), "node", "print")
    assert {roots[n]: p for n, p in out} == cases


def test_all_operands_and_kinds_count(table):
    schema = "func_id bigint, node string, parent string, pos int, op string, var string, value decimal(38,0)"
    lists = [("f", "x", "y"), ("f", "x", "z"), ("f", "x"), ("f", "x", "y", "z"), ("f", "x", "z", "y"), ("f", "x", "y"), ("5",), (5,), ("negate(a)",), ("b`(",)]
    rows = []
    for i, parts in enumerate(lists):
        rows.append((i, "r", None, 0, "call", None, None))
        rows += [(i, f"n{k}", "r", k, None, p if isinstance(p, str) else None, __import__("decimal").Decimal(p) if isinstance(p, int) else None) for k, p in enumerate(parts)]
    fp = dict(got(tr.canonical_expressions(table(schema, rows)).filter("parent IS NULL"), "func_id", "fp"))
    assert fp[0] == fp[5] and len(set(fp.values())) == len(lists) - 1
    three = [(1, "r", None, 0, "plus", None, None), (1, "a", "r", 0, None, "a", None), (1, "b", "r", 1, None, None, __import__("decimal").Decimal(0)), (1, "c", "r", 2, None, "c", None)]
    assert got(tr.canonical_expressions(table(schema, three)).filter("parent IS NULL"), "print") != {"a"}


def test_fingerprints_of_branches(table):
    schema = "func_id bigint, node string, parent string, pos int, label string"
    one = [(1, "r", None, 0, "if"), (1, "x", "r", 0, "A"), (1, "y", "r", 0, "B")]
    two = [(2, "r", None, 0, "if"), (2, "x", "r", 0, "B"), (2, "y", "r", 0, "A")]
    three = [(3, "r", None, 0, "if"), (3, "x", "r", 0, "A"), (3, "y", "r", 1, "B")]
    out = dict(got(tr.tree_fingerprint(table(schema, one + two + three)).filter("parent IS NULL"), "func_id", "fp"))
    assert out[1] == out[2] != out[3]


def test_dependency_scores(table):
    schema = "func_id bigint, node int, parent int, op string, var string"
    # a + (a + 1) + call(b)
    rows = [(1, 0, None, "plus", None), (1, 1, 0, None, "a"), (1, 2, 0, "plus", None), (1, 3, 2, None, "a"), (1, 4, 2, None, None), (1, 5, 0, "call", None), (1, 6, 5, None, "b")]
    out = {(x, round(s, 6)) for x, s in got(tr.dependency_scores(table(schema, rows)), "var", "score")}
    assert out == {("a", round(0.45 + 0.9 * 0.45, 6))}


def test_unsafe_between_by_brute_force(edges, table):
    e = edges("a>b b>c c>b c>d a>d")
    order = {b: i for i, b in enumerate("abcd")}
    rnd = random.Random(4)
    pairs = [(1, i, rnd.choice("abcd"), rnd.randrange(5), rnd.choice("abcd"), rnd.randrange(5)) for i in range(60)]
    danger = [(1, "b", 2), (1, "d", 1)]
    out = got(f.unsafe_between(e, table("func_id bigint, pair int, def_block string, def_idx int, use_block string, use_idx int", pairs), table("func_id bigint, block string, idx int", danger)), "pair")
    reach = {"a": set("abcd"), "b": set("bcd"), "c": set("bcd"), "d": {"d"}}

    def unsafe(db, di, ub, ui):
        for _, b, i in danger:
            if db == ub:
                if b == db and di <= i < ui:
                    return True
            elif b == ub:
                if i < ui:
                    return True
            elif b == db:
                if i > di:
                    return True
            elif b in reach[db] and ub in reach[b]:
                return True
        return False

    assert order and out == {p[1] for p in pairs if unsafe(*p[2:])}
