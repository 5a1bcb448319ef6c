"""Counting and ranking: registries, common expressions, access patterns, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary import fixpoint
from tributary.fixpoint import GROUP, dealt_out, edge_table, largest
from tributary.functions.ordered import MAX_ROWS, Ordered
from tributary.operators.graph import levels
from tributary.tables import Rounds, cut, keep, settled, stored


def var_registry(occurrences: DataFrame) -> DataFrame:
    """(func_id, name, ssa, n): occurrences per variable version."""
    return occurrences.groupBy(GROUP, "name", "ssa").agg(F.count(F.lit(1)).alias("n"))


def harmonize_type(occurrences: DataFrame) -> DataFrame:
    """Occurrences with ``type`` set to the first seen (by ``ord``) of their (name, ssa)."""
    return _of_group(occurrences, [GROUP, "name", "ssa"], "type", F.min_by("type", "ord"))


def _of_group(rows: DataFrame, keys: Sequence[str], column: str, value: Column) -> DataFrame:
    """``rows`` with ``column`` set to an aggregate over rows of equal keys; nulls are equal."""
    per_key = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(value.alias("_value"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(per_key, same).withColumn(column, F.col("_value")).select(*rows.columns)


def harmonize_aliased(occurrences: DataFrame) -> DataFrame:
    """Occurrences with ``aliased`` set if any occurrence of their name is aliased."""
    return _of_group(occurrences, [GROUP, "name"], "aliased", F.bool_or("aliased"))


def common_expr(uses: DataFrame, threshold: int = 2, intra: bool = False, string_threshold: int = 2, min_length: int = 8) -> DataFrame:
    """(func_id, fp, n_rows, n): expressions worth a variable of their own.

    ``uses(func_id, fp, idx, n, complexity, text, barred)``: ``n`` occurrences in row ``idx``; ``text`` the content of a string constant;
    ``barred`` for lists and what holds a dereference or call. Referencing rows count, or occurrences if ``intra``.
    """
    return _candidates(_per_expr(uses), threshold, intra, string_threshold, min_length).select(GROUP, "fp", "n_rows", "n")


def _per_expr(uses: DataFrame) -> DataFrame:
    per_row = uses.filter("NOT barred").groupBy(GROUP, "fp", "idx").agg(F.sum("n").alias("n"), F.max("complexity").alias("complexity"), F.max("text").alias("text"))
    return per_row.groupBy(GROUP, "fp").agg(
        F.count_if(F.col("n") > 0).alias("n_rows"), F.sum("n").alias("n"), F.max("complexity").alias("complexity"), F.max("text").alias("text")
    )


def _candidates(exprs: DataFrame, threshold: int, intra: bool, string_threshold: int, min_length: int) -> DataFrame:
    count = F.col("n" if intra else "n_rows")
    complex_enough = (F.col("complexity") >= 2) & (count >= max(threshold, 2))
    long_string = F.coalesce(F.length("text") >= min_length, F.lit(False)) & (count >= max(string_threshold, 2))
    return exprs.filter(complex_enough | long_string)


def common_expr_greedy(
    uses: DataFrame, parts: DataFrame, threshold: int = 2, intra: bool = False, string_threshold: int = 2, min_length: int = 8
) -> DataFrame:
    """As ``common_expr``, the most complex first: what is chosen takes its uses away from the expressions inside it.

    ``parts(func_id, fp, part, n)``: how often an expression holds a part. An expression is decided when all that hold it are, so there are as many
    rounds as expressions are nested. What is taken away is logged, and looked up by the round that needs it. Where functions are small all tables
    are dealt out by function, and no round shuffles.
    """
    uses = dealt_out(uses)
    left = uses.filter("NOT barred").groupBy(GROUP, "fp", "idx").agg(F.sum("n").alias("n"), F.max("complexity").alias("complexity"), F.max("text").alias("text"))
    parts = settled(parts.select(GROUP, "fp", "part", F.col("n").alias("per")), uses._dealt)
    dealt = uses._dealt if uses._dealt and largest(parts) <= fixpoint.GRAPH else 0
    inside = edge_table(parts.select(GROUP, F.col("fp").alias("src"), F.col("part").alias("dst")).filter("src <> dst"), uses if dealt else None)
    nested = levels(inside).select(GROUP, F.col("node").alias("fp"), "level")
    left = keep(left.join(nested, [GROUP, "fp"], "left").withColumn("level", F.coalesce("level", F.lit(0))), dealt)
    deepest = left.agg(F.max("level")).first()[0]
    chosen, logs = Rounds(dealt), Rounds(dealt)
    for level in range(-1 if deepest is None else deepest + 1):
        here = left.filter(F.col("level") == level).drop("level").withColumn("barred", F.lit(False))
        if logs.n:
            minus = logs.all().groupBy(GROUP, "fp", "idx").agg(F.sum("minus").alias("minus"))
            here = here.join(minus, [GROUP, "fp", "idx"], "left").withColumn("n", F.col("n") - F.coalesce("minus", F.lit(0))).drop("minus")
        found, n = chosen.add(_candidates(_per_expr(here), threshold, intra, string_threshold, min_length).select(GROUP, "fp", "n_rows", "n"))
        if n and level < deepest:
            taken = here.join(found.select(GROUP, "fp"), [GROUP, "fp"], "left_semi").select(GROUP, "fp", "idx", F.col("n").alias("times"))
            taken = taken.join(parts, [GROUP, "fp"]).groupBy(GROUP, F.col("part").alias("fp"), "idx")
            logs.add(taken.agg(F.sum(F.col("times") * F.col("per")).alias("minus")))
    if not chosen.n:
        return left.select(GROUP, "fp", F.col("n").alias("n_rows"), "n").limit(0)
    return chosen.all()


def hot_expr(uses: DataFrame) -> DataFrame:
    """(func_id, fp, complexity, parents): complexity and parents at least 2, their product above 5."""
    out = uses.groupBy(GROUP, "fp").agg(F.max("complexity").alias("complexity"), F.countDistinct("parent").alias("parents"))
    return out.filter("complexity >= 2 AND parents >= 2 AND complexity * parents > 5")


def strided_access(accesses: DataFrame) -> DataFrame:
    """Accesses that look like elements of an array, with ``stride``, ``index`` (of constant offsets) and ``confident``.

    ``accesses(func_id, base, cls, value, element, …)``: offsets of class const (value the offset), var (1) or mul (the factor);
    ``element`` the element size if known, else 0. A base qualifies with exactly one var or exactly one mul stride and not both kinds,
    equal to a known element size, and all constant offsets divisible by it.
    """
    key = [GROUP, "base"]

    def of(cls: str) -> Column:
        return F.when(F.col("cls") == cls, F.col("value"))

    base = accesses.groupBy(*key).agg(
        F.min(of("var")).alias("v0"), F.max(of("var")).alias("v1"), F.min(of("mul")).alias("m0"), F.max(of("mul")).alias("m1"), F.max("element").alias("known")
    )
    single = F.when(F.col("m0").isNull() & (F.col("v0") == F.col("v1")), F.col("v0")).when(F.col("v0").isNull() & (F.col("m0") == F.col("m1")), F.col("m0"))
    base = base.select(*key, single.alias("stride"), "known").filter("stride IS NOT NULL AND (known = 0 OR known = stride)")
    rows = accesses.join(base, key)
    odd = rows.filter("cls = 'const' AND value % stride <> 0").select(*key).distinct()
    # all constant offsets divide without rest; whole numbers above 2**53 would not survive a division of doubles
    index = F.when(F.col("cls") == "const", F.expr("value div stride"))
    return rows.join(odd, key, "left_anti").select(*accesses.columns, "stride", index.alias("index"), (F.col("known") > 0).alias("confident"))


def modal_class(occurrences: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(func_id, name, cls): the most frequent allowed class of a name; the smaller one if equal."""
    counted = occurrences.filter(F.col("cls").isin(*allowed)).groupBy(GROUP, "name", "cls").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(GROUP, "name").agg(F.min_by("cls", F.struct(-F.col("n"), F.col("cls"))).alias("cls"))


def percentiles(values: DataFrame, keys: Sequence[str], column: str, wanted: Mapping[str, float], max_rows: int = MAX_ROWS) -> DataFrame:
    """(*keys, one column per name of ``wanted``): exact percentiles of ``column``, interpolated between neighbours; nulls do not count.

    Equal values are counted first. The counts of a group are then added up in order of value, in pieces where it has many values, and the rows
    are picked in which the wanted places lie: no task holds the values of a group.
    """
    # as fields of a struct, null keys are equal to each other
    values = values.select(F.struct(*keys).alias("_key"), column).filter(F.col(column).isNotNull())
    counted = keep(values.groupBy("_key", column).agg(F.count(F.lit(1)).alias("_n")))
    total = counted.groupBy("_key").agg(F.sum("_n").alias("_total"))
    rows = Ordered(counted, ["_key"], [column], max_rows).running_sum("_n", "_end").join(total, "_key")
    picked, results = [], []
    for name, part in wanted.items():
        at = F.lit(part) * (F.col("_total") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_end") - F.col("_n") <= place) & (place < F.col("_end"))
            picked.append(F.max(F.when(inside, F.col(column))).cast("double").alias(f"_{name}_{side}"))
        share = F.lit(part) * (F.col("_total") - 1) - F.floor(F.lit(part) * (F.col("_total") - 1))
        results.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * share).alias(name))
    return rows.groupBy("_key", "_total").agg(*picked).select(*[F.col(f"_key.{k}").alias(k) for k in keys], *results)


def report_summary(reports: DataFrame, dims: Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Rolled up over ``dims``: rows, success rate, time (mean, median, 90th percentile, largest) and size (mean, largest).

    Rows per failure are kept apart in ``failure_top``.
    """
    out = reports.rollup(*dims).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_successful").alias("n_ok"),
        (F.count_if("is_successful") / F.count(F.lit(1))).alias("success_rate"),
        F.avg("seconds").alias("avg_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.avg("function_size").alias("avg_size"),
        F.max("function_size").alias("max_size"),
    )
    # the same rows, once per set of the roll-up
    sets = [F.struct(F.lit(2**k - 1).cast("bigint").alias("_set"), *[F.col(d) if i < len(dims) - k else F.lit(None).cast(reports.schema[d].dataType).alias(d) for i, d in enumerate(dims)]) for k in range(len(dims) + 1)]
    spread = reports.select(F.explode(F.array(*sets)).alias("_s"), "seconds").select("_s.*", "seconds")
    times = percentiles(spread, ["_set", *dims], "seconds", {"median_seconds": 0.5, "p90_seconds": 0.9}, max_rows)
    times = times.toDF("_set2", *[f"_{d}" for d in dims], "median_seconds", "p90_seconds")
    same = [F.col("_set") == F.col("_set2"), *[F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dims]]
    out = out.join(times, reduce(and_, same), "left")
    return out.select(*dims, "n", "n_ok", "success_rate", "avg_seconds", "median_seconds", "p90_seconds", "max_seconds", "avg_size", "max_size")


def failure_top(reports: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent failures, ties by name."""
    return reports.filter("NOT is_successful").groupBy("exception").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "exception").limit(k)


def duplicate_nodes(rows: DataFrame) -> DataFrame:
    """(func_id, node, n): objects that occur in several rows."""
    return rows.select(GROUP, "node", "idx").distinct().groupBy(GROUP, "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def case_groups(literals: DataFrame) -> DataFrame:
    """(func_id, expr, n_cases, n_conditions): expressions compared with several constants; fewer conditions than cases means that
    identical conditions occur. ``literals(func_id, expr, constant, condition)``."""
    out = literals.groupBy(GROUP, "expr").agg(F.count(F.lit(1)).alias("n_cases"), F.countDistinct("constant").alias("n_conditions"))
    return out.filter("n_cases > 1")


def invert_map(entries: DataFrame) -> DataFrame:
    """(func_id, target, ord, value): ``entries(func_id, value, target)`` the other way round, the values of a target ascending.

    One row per value instead of a list per target, since a target may have any number of them.
    """
    return Ordered(entries.distinct(), [GROUP, "target"], ["value"]).row_number("ord").select(GROUP, "target", "ord", "value")


def extents(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items with ``extent``: the distance to the next address, the last one reaching to the end of its section (``end``)."""
    following = Ordered(items.withColumn("_back", -F.col("address")), keys, ["_back"]).previous("address", "_next")
    return following.withColumn("extent", F.coalesce("_next", "end") - F.col("address")).drop("_next", "_back")


def counter_names(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``label``: prefix, identifier and how many of the same came before in the function."""
    out = Ordered(rows, [GROUP, "identifier", "prefix"], order).row_number("_n")
    return out.withColumn("label", F.concat("prefix", "identifier", (F.col("_n") - 1).cast("string"))).drop("_n")


def earliest_version(rows: DataFrame) -> DataFrame:
    """(func_id, name, var): the variable with the lowest version of a name."""
    return rows.groupBy(GROUP, "name").agg(F.min_by("var", "ver").alias("var"))


def insertion_index(blocks: DataFrame, uses: DataFrame) -> DataFrame:
    """(func_id, block, position): the first use in the block, else before a branch that ends it, else its end.

    ``blocks(func_id, block, n_rows, last_kind)``, ``uses(func_id, block, position)`` with positions from 0.
    """
    first = uses.groupBy(GROUP, "block").agg(F.min("position").alias("first"))
    end = F.when(F.col("last_kind") == "branch", F.col("n_rows") - 1).otherwise(F.col("n_rows"))
    return blocks.join(first, [GROUP, "block"], "left").select(GROUP, "block", F.coalesce("first", end).alias("position"))


def unique_names(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows with ``unique_name``: name, then name__2, name__3 for repetitions inside ``key``."""
    out = Ordered(rows, [key, "name"], order).row_number("_n")
    return out.withColumn("unique_name", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat_ws("__", "name", F.col("_n").cast("string")))).drop("_n")


def unique_by_address(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of globals with ``unique_name``: repeated names get their address in hexadecimal."""
    out = Ordered(rows, ["name"], order).row_number("_n")
    late = F.concat(F.col("name"), F.lit("_"), F.lower(F.hex("address")))
    return out.withColumn("unique_name", F.when(F.col("_n") == 1, F.col("name")).otherwise(late)).drop("_n")


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group; Spark limits each group before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def all_equal(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(*keys, all_equal): whether a group holds at most one value."""
    return rows.groupBy(*keys).agg((F.coalesce(F.min(column) == F.max(column), F.lit(True))).alias("all_equal"))


def member_at(members: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(type_id, offset)`` with the member's name, ``field_0x<hex offset>`` where the type has none there."""
    out = asked.join(members.select("type_id", "offset", "member"), ["type_id", "offset"], "left")
    sign = F.when(F.col("offset") < 0, "field_minus_0x").otherwise("field_0x")
    return out.withColumn("member", F.coalesce("member", F.concat(sign, F.lower(F.hex(F.abs("offset"))))))


def member_by_type(members: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(type_id, type)`` with the first member (by offset, then name) of that type, else ``unknown_field``."""
    first = members.groupBy("type_id", "type").agg(F.min(F.struct("offset", "member")).getField("member").alias("member"))
    return asked.join(first, ["type_id", "type"], "left").na.fill("unknown_field", ["member"])


def enum_name(members: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(type_id, value)`` with the name of the enum member of that value; null where there is none."""
    return asked.join(members.select("type_id", F.col("offset").alias("value"), "member"), ["type_id", "value"], "left")


def edges_with(edges: DataFrame, parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges that hold one of the wanted items; ``parts(func_id, src, dst, item)``."""
    return edges.join(parts.join(wanted, [GROUP, "item"], "left_semi"), [GROUP, "src", "dst"], "left_semi")
