"""Small trees are simplified in batches of whole groups: the same forms as level by level, without a shuffle, join or stored round per level."""

import random
from decimal import Decimal

import pyarrow as pa
import pytest
from conftest import got
from pyspark.sql import functions as F

from tributary.functions.scalar import fold_constants
from tributary.operators import forms, trees
from tributary.plans import QUERIES

NODE = "func_id bigint, node string, parent string, pos int, op string, var string, value decimal(38,0)"
OPS = [
    "plus", "minus", "multiply", "multiply_us", "divide", "divide_us", "modulo", "modulo_us", "bitwise_or", "bitwise_and", "bitwise_xor", "left_shift",
    "right_shift", "right_shift_us", "logical_and", "logical_or", "negate", "bitwise_not", "less", "call", "address", "dereference", None,
]
NUMBERS = [0, 1, -1, 2, 3, 5, 31, 32, 40, 63, 70, -7, 2**31, -(2**31), 2**32 - 1, 2**45 + 3, 2**63 - 1, -(2**63)]


def some_trees(seed, n=240):
    """Trees with gaps, long lists, repeated and missing nodes, cycles, nodes without a name, place, operation or group."""
    rng, rows = random.Random(seed), []
    for f in range(n):
        group = None if f == 7 else f // 3
        size = rng.randrange(1, 9)
        for i in range(size):
            parent = None if not i else f"{f}:{rng.randrange(max(0, i - 4), i)}"
            if rng.random() < 0.02:
                parent = rng.choice([None, "nobody", f"{f}:{rng.randrange(size)}"])
            pos = rng.choice([0, 1, 0, 1, 0, 1, 0, 1, 2, 3, None, -1])
            number, odd = rng.random() < 0.6, rng.random() < 0.03
            var = None if number or odd else rng.choice(["x", "y", "x", "y", "z`(", "5", "negate(a)", "", "a b"])
            op = rng.choice([*OPS, *OPS[:3], "plus", "bitwise_and", "multiply", "negate"])
            rows.append((group, None if rng.random() < 0.01 else f"{f}:{i}", parent, pos, op, var, Decimal(rng.choice([0, 1, 2, *NUMBERS])) if number else None))
    # places are taken once, so that no result is left to chance
    taken, out = set(), []
    for row in rows:
        if row[3] in (0, 1) and (row[0], row[2], row[3]) in taken:
            row = (*row[:3], 2, *row[4:])
        taken.add((row[0], row[2], row[3]))
        out.append(row)
    twice = [r for r in out if r[3] == 2][:5]
    return out + twice


@pytest.mark.parametrize(("size", "signed", "most"), [(32, True, 0), (64, False, 14)])
def test_batches_and_levels_give_the_same_forms(table, monkeypatch, size, signed, most):
    nodes = table(NODE, some_trees(size))

    def all_of(**more):
        return sorted(map(str, trees.canonical_expressions(nodes, size, signed, **more).collect()))

    together = all_of()
    roots = [str(r) for r in trees.canonical_expressions(nodes, size, signed, roots=True).collect()]
    monkeypatch.setattr(trees, "TOGETHER", most)
    assert all_of() == together and len(together) > 900
    assert sorted(roots) == [r for r in together if "parent=None" in r]


def test_folding_as_columns_do(table):
    assert forms.folded("left_shift", 2**63 - 1, 2, 64) == -4
    rows = [(op, a, b) for op in OPS if op for a in NUMBERS for b in NUMBERS]
    rows = [(op, Decimal(a), Decimal(b)) for op, a, b in rows]
    given = table("op string, a decimal(38,0), b decimal(38,0)", rows)
    for size, signed in ((32, True), (32, False), (64, True), (64, False), (8, True)):
        for r in fold_constants(given, "op", "a", "b", "v", size, signed).collect():
            want = None if r.v is None else int(r.v)
            assert forms.folded(r.op, int(r.a), int(r.b), size, signed) == want, (r, size, signed)


def test_several_nodes_in_a_row(table):
    nodes = table(NODE, [r for r in some_trees(5) if r[0] is not None])
    rest = [c for c in nodes.columns if c != "func_id"]
    packed = nodes.groupBy("func_id", (F.hash("node") % 3).alias("part")).agg(F.collect_list(F.struct(*rest)).alias("nodes")).drop("part")
    packed = packed.unionByName(table("func_id bigint, nodes " + packed.schema["nodes"].dataType.simpleString(), [(1, []), (2, None)]))
    one, many = (sorted(map(str, trees.canonical_expressions(n).collect())) for n in (nodes, packed))
    assert one == many and one


def test_large_groups_of_several_nodes_in_a_row(table, monkeypatch):
    rows = [(g, [("r", None, 0, "plus", None, None), ("a", "r", 0, None, "a", None)]) for g in (1, 2)] + [(2, [("b", "r", 1, None, None, Decimal(3))])]
    packed = table("func_id bigint, nodes array<struct<node:string,parent:string,pos:int,op:string,var:string,value:decimal(38,0)>>", rows)
    monkeypatch.setattr(trees, "TOGETHER", 2)
    assert got(trees.canonical_expressions(packed, roots=True), "func_id", "node", "print") == {(1, "r", "plus(a)"), (2, "r", "plus(a,3)")}


def test_groups_stay_whole():
    groups = [None, None, 1, 1, 1, 2, 3, 3, 3, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(groups[a:b], pa.int64())], names=["func_id"]) for a, b in ((0, 1), (1, 4), (4, 4), (4, 7), (7, 9), (9, 12), (12, 13))]
    out = [b.column(0).to_pylist() for b in forms.whole_groups(iter(batches))]
    assert sum(out, []) == groups
    assert all({*a}.isdisjoint(b) for i, a in enumerate(out) for b in out[i + 1 :] if a[-1] is not None)


def test_the_query_deals_its_lines_out_once(spark):
    plan = QUERIES["canonical_expressions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
