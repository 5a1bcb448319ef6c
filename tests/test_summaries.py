"""Percentiles, greedy choice and products against plain computations."""

import random

import numpy as np
import pytest
from conftest import got

from tributary.operators import graph, mining, versions


@pytest.mark.parametrize("max_rows", [5, 2_000_000])
def test_percentiles(table, max_rows):
    pick, rows = random.Random(3), []
    for arch in ("x", "y", None):
        for platform in ("p", None):
            rows += [(arch, platform, pick.random() < 0.7, pick.choice([pick.random() * 100, float(pick.randrange(9)), None]), pick.randrange(50)) for _ in range(pick.randrange(1, 60))]
    reports = table("arch string, platform string, is_successful boolean, seconds double, function_size int", rows)
    out = mining.report_summary(reports, ["arch", "platform"], max_rows=max_rows).collect()
    assert len(out) == 6 + 3 + 1
    groups = [[r for r in rows if r[:2] == k] for k in {r[:2] for r in rows}] + [[r for r in rows if r[0] == a] for a in ("x", "y", None)] + [rows]

    def summary(some):
        seconds = [r[3] for r in some if r[3] is not None]
        half, most = (float(np.percentile(seconds, q)) for q in (50, 90))
        return len(some), sum(r[2] for r in some), round(half, 9), round(most, 9), max(seconds)

    assert sorted((r.n, r.n_ok, round(r.median_seconds, 9), round(r.p90_seconds, 9), r.max_seconds) for r in out) == sorted(map(summary, groups))


def test_percentiles_of_nothing(table):
    reports = table("arch string, is_successful boolean, seconds int, function_size int", [("x", True, None, 1)])
    rows = mining.report_summary(reports, ["arch"]).collect()
    assert [(r.arch, r.n, r.median_seconds) for r in sorted(rows, key=lambda r: r.arch or "")] == [(None, 1, None), ("x", 1, None)]


def test_greedy_choice_follows_nesting(table):
    """Expressions of many complexities, each chosen one takes its uses away from what it holds, at any depth."""
    pick = random.Random(7)
    held = {f"e{i:02}": sorted({f"e{pick.randrange(i):02}" for _ in range(pick.randrange(3))}) if i else [] for i in range(25)}

    def times(fp):  # how often an expression holds each other one, itself once
        out = {fp: 1}
        for part in held[fp]:
            for k, n in times(part).items():
                out[k] = out.get(k, 0) + n
        return out

    size = {fp: 1 + sum(times(fp).values()) for fp in held}
    uses, parts = {}, []
    for func in (1, 2):
        for idx in range(12):
            for fp in pick.sample(sorted(held), 3):
                for k, n in times(fp).items():
                    uses[func, k, idx] = uses.get((func, k, idx), 0) + n
        parts += [(func, fp, k, n) for fp in held for k, n in times(fp).items() if k != fp]
    rows = [(f, fp, idx, n, size[fp], None, False) for (f, fp, idx), n in uses.items()]
    out = mining.common_expr_greedy(table("func_id bigint, fp string, idx int, n bigint, complexity int, text string, barred boolean", rows), table("func_id bigint, fp string, part string, n bigint", parts))
    want, left = set(), dict(uses)
    for func in (1, 2):
        for fp in sorted(held, key=lambda x: -size[x]):
            mine = {idx: n for (f, k, idx), n in left.items() if (f, k) == (func, fp)}
            used = sum(n > 0 for n in mine.values())
            if used >= 2 and size[fp] >= 2:
                want.add((func, fp, used, sum(mine.values())))
                for idx, n in mine.items():
                    for k, per in times(fp).items():
                        if k != fp:
                            left[func, k, idx] -= n * per
    assert got(out, "func_id", "fp", "n_rows", "n") == want and len(want) > 10


def test_products_are_spread(table, spark):
    left = table("func_id bigint, a int", [(1, i) for i in range(300)] + [(2, 1), (3, 1)])
    right = table("func_id bigint, b int", [(1, i) for i in range(200)] + [(2, 5), (2, 6), (4, 1)])
    out = versions.product(left, right, per_task=1000)
    assert got(out, "func_id", "a", "b") == {(1, i, j) for i in range(300) for j in range(200)} | {(2, 1, 5), (2, 1, 6)} and out.count() == 60_002
    assert versions.product(left.limit(0), right).count() == 0


def test_paths_of_lonely_nodes(table, edges):
    pairs = table("func_id bigint, src string, dst string", [(1, "a", "a"), (1, "x", "x"), (1, "y", "y"), (1, "a", "b"), (1, "b", "a"), (1, "a", "x")])
    nodes = table("func_id bigint, node string", [(1, "x")])
    found = graph.has_path(edges("a>b"), pairs, nodes=nodes).filter("found")
    assert got(found, "src", "dst") == {("a", "a"), ("x", "x"), ("a", "b")}
