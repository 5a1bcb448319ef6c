"""Simplified forms of expressions, many small trees at a time: a batch of whole trees is folded where it lies, without a join per level.

Links between nodes are numbers worked out for a whole batch; the rules run once per operation, children first. They are those that
``trees.canonical_expressions`` states for large trees, and give the same forms.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tributary.fixpoint import GROUP

COMMUTATIVE = ("plus", "multiply", "bitwise_and", "bitwise_or", "bitwise_xor")
LOGICAL = ("logical_and", "logical_or")
SHIFTS = ("left_shift", "right_shift", "right_shift_us")
#: Operations that a right operand of 0 or 1 leaves as it is; what 0 makes 0; what an operand twice leaves as it is.
ZERO, ONE = ("plus", "bitwise_or", "bitwise_xor", "logical_or", *SHIFTS), ("multiply", "multiply_us", "divide", "divide_us")
ABSORBED = ("multiply", "multiply_us", "bitwise_and", "logical_and")
TWICE = ("bitwise_or", "bitwise_and", *LOGICAL)
#: Several nodes of a group in one row.
NODES = "nodes"
PLAIN = re.compile(r"^[A-Za-z_.$@#][^(),;`]*$")

#: What is known of an expression: its value if constant, its text, and, for ``base op constant``, these three. None where it has none.
Form = tuple[int | None, str | None, str | None, str | None, int | None]


def _const(value: int) -> Form:
    return value, str(value), None, None, None


def _text(*parts: str | None) -> Form:
    return None, None if None in parts else "".join(parts), None, None, None


def _name(var: str | None) -> Form:
    return _text(var if var is None or PLAIN.search(var) else "`" + var.replace("`", "``") + "`")


def folded(op: str | None, left: int, right: int, size: int = 32, signed: bool = True) -> int | None:
    """The value of an operation on constants as ``scalar.fold_constants`` gives it."""
    mask, half = (1 << size) - 1, 1 << (size - 1)
    ua, ub, n = left & mask, right & mask, max(right, -1)
    a, b = (ua ^ half) - half, (ub ^ half) - half
    if op == "plus":
        v = a + b
    elif op == "minus":
        v = a - b
    elif op in ("multiply", "multiply_us"):
        v = a * b
    elif op == "bitwise_or":
        v = a | b
    elif op == "bitwise_and":
        v = a & b
    elif op == "bitwise_xor":
        v = a ^ b
    elif op == "negate":
        v = -a
    elif op == "bitwise_not":
        v = ~a
    elif op in SHIFTS:
        if n < 0:
            return None
        n = min(n, size)
        own = ua if op == "right_shift_us" or not signed else a
        v = own << n if op == "left_shift" else own >> n
    elif op in ("divide", "modulo"):
        if not b:
            return None
        v = a // b if op == "divide" else a % b * (-1 if a < 0 else 1)
    elif op in ("divide_us", "modulo_us"):
        if not ub:
            return None
        v = ua // ub if op == "divide_us" else ua % ub
    else:
        return None
    v &= mask
    return (v ^ half) - half if signed else v


def _neutral(op: str | None, value: int) -> bool:
    return value == 0 and op in ZERO or value == 1 and op in ONE or value != 0 and op == "logical_and"


def _chained(op: str, base: str | None, k: int) -> Form:
    if k == 0 and op in ("multiply", "bitwise_and"):
        return _const(0)
    if _neutral(op, k):
        return _text(base)
    return None, None if base is None else f"{op}({base},{k})", op, base, k


def simplified(op: str | None, left: Form | None, right: Form | None, size: int = 32, signed: bool = True) -> Form | None:
    """The form of an operation on one or two operands; None where an operand is missing."""
    x, z, own = left, right, op
    if op == "negate" or op == "minus" and right is not None:
        c, text, *_ = (left if op == "negate" else right) or _text(None)
        if c is not None:
            turned = _const(folded("negate", c, c, size, signed))
        elif text is not None and text.startswith("negate("):
            turned = _text(text[7:-1])
        else:
            turned = _text("negate(", text, ")")
        if op == "negate":
            return turned
        # a - b becomes a + (-b)
        op, z = "plus", turned
    commuting = op in COMMUTATIVE
    # constants to the right
    if z is not None and z[0] is None and x is not None and x[0] is not None and (commuting or op in LOGICAL):
        x, z = z, x
    xc, xp, x_chain, x_base, x_k = x or _text(None)
    if z is None:
        both = None if xc is None else folded(op, xc, xc, size, signed)
        if both is not None:
            return _const(both)
        if op == "dereference" and xp is not None and xp.startswith("address("):
            return _text(xp[8:-1])
        return _text(op, "(", xp, ")")
    zc, zp, z_chain, z_base, z_k = z
    if xc is not None and zc is not None:
        if op in LOGICAL:
            return _const(int(bool(xc and zc) if op == "logical_and" else bool(xc or zc)))
        both = folded(op, xc, zc, size, signed)
        if both is not None:
            return _const(both)
    if xc is None:
        # constants of chains of the same operation
        xk = x_k if commuting and x_chain == op else None
        xb = xp if xk is None else x_base
        if zc is not None:
            if _neutral(op, zc):
                return x
            if zc == 0 and op in ABSORBED:
                return _const(0)
            if zc != 0 and op == "logical_or":
                return _const(1)
            if commuting:
                return _chained(op, xb, zc if xk is None else folded(op, xk, zc, size, signed))
    if xp is not None and xp == zp:
        if op in TWICE:
            return x
        if op == "bitwise_xor":
            return _const(0)
    if xc is None and zc is None and commuting:
        zk = z_k if z_chain == op else None
        if xk is not None or zk is not None:
            k = zk if xk is None else xk if zk is None else folded(op, xk, zk, size, signed)
            return _chained(op, _text(op, "(", xb, ",", zp if zk is None else z_base, ")")[1], k)
    return _text(op, "(", xp, ",", zp, ")")


def _longer(op: str | None, left: Form | None, right: Form | None, more: list[tuple[int, str | None]]) -> Form:
    """The form of a longer list: the operands behind the second by their number and the sums of their digests."""
    a = b = 0
    for pos, text in more:
        digits = hashlib.sha256((str(pos) if text is None else f"{pos}:{text}").encode()).hexdigest()
        a, b = a + int(digits[:15], 16), b + int(digits[15:30], 16)
    first, second = ((form and form[1]) or "" for form in (left, right))
    return _text(op, "(", first, ",", second, ";", str(len(more)), ":", str(a), ":", str(b), ")")


def _codes(array: pa.Array) -> tuple[np.ndarray, list]:
    """A number for every value, -1 for null, and the values by their numbers."""
    coded = array.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def texts(rows: pa.RecordBatch, size: int, signed: bool) -> tuple[list[str | None], np.ndarray]:
    """The simplified text of every node, and which nodes are done; those on a cycle or above one never are."""
    n, column = rows.num_rows, rows.column
    group, _ = _codes(column(GROUP))
    names, distinct = _codes(pa.concat_arrays([column("node"), column("parent").cast(column("node").type)]))
    node, parent = names[:n], names[n:]
    # a family is the children of one parent; a node without a family is a leaf
    key = np.where((group >= 0) & (parent >= 0), group * len(distinct) + parent, -1)
    families, up = np.unique(key, return_inverse=True)
    if len(families) and families[0] < 0:
        families, up = families[1:], up - 1
    own = np.where((group >= 0) & (node >= 0), group * len(distinct) + node, -2)
    family = np.searchsorted(families, own)
    family[family == len(families)] = -1
    if len(families):
        family[families[family] != own] = -1
    pos = column("pos").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    first, second = np.full(len(families), -1), np.full(len(families), -1)
    child = up >= 0
    for at, places in ((first, 0), (second, 1)):
        rows_at = np.flatnonzero(child & (pos == places))
        at[up[rows_at]] = rows_at
    more = defaultdict(list)
    for i in np.flatnonzero(child & (pos >= 2)).tolist():
        more[int(up[i])].append(i)

    values, constants = _codes(column("value").cast(pa.string()))
    variables, called = _codes(column("var").cast(pa.string()))
    constants = [(int(Decimal(v).to_integral_value(ROUND_HALF_UP)), v, None, None, None) for v in constants]
    called = [*map(_name, called), _name(None)]
    leaf = np.flatnonzero(family < 0)
    forms: list[Form | None] = [None] * n
    for i, v, name in zip(leaf.tolist(), values[leaf].tolist(), variables[leaf].tolist()):
        forms[i] = constants[v] if v >= 0 else called[name]

    ops, operations = _codes(column("op").cast(pa.string()))
    operations.append(None)
    inner = np.flatnonzero(family >= 0)
    inner = inner[np.argsort(family[inner], kind="stable")]
    starts = np.searchsorted(family[inner], np.arange(len(families) + 1)).tolist()
    waiting = np.bincount(up[inner][up[inner] >= 0], minlength=len(families))
    ready = np.flatnonzero(waiting == 0).tolist()
    waiting, first, second, up_of, op_of, inner = waiting.tolist(), first.tolist(), second.tolist(), up[inner].tolist(), ops[inner].tolist(), inner.tolist()
    done = family < 0
    while ready:
        at = ready.pop()
        for k in range(starts[at], starts[at + 1]):
            op, l, r = operations[op_of[k]], first[at], second[at]
            left, right = None if l < 0 else forms[l], None if r < 0 else forms[r]
            if at in more:
                form = _longer(op, left, right, [(int(pos[i]), forms[i] and forms[i][1]) for i in more[at]])
            else:
                form = simplified(op, left, right, size, signed)
            forms[inner[k]] = form
            done[inner[k]] = True
            over = up_of[k]
            if over >= 0:
                waiting[over] -= 1
                if not waiting[over]:
                    ready.append(over)
    return [form and form[1] for form in forms], done


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order of their group, cut anew so that none ends inside a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column(GROUP)
        last = groups[-1]
        # nodes without a group have no children, and wait for nobody
        begin = groups.index(last).as_py() if last.is_valid else batch.num_rows
        if begin or held and held[-1].column(GROUP)[-1] != last:
            yield pa.concat_batches([*held, batch.slice(0, begin)])
            held = []
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.concat_batches(held)


def packed(nodes: DataFrame) -> bool:
    """Whether rows are (func_id, nodes): some nodes of a group each, in an array of structures."""
    return nodes.columns == [GROUP, NODES]


def unpacked(rows: pa.RecordBatch) -> pa.RecordBatch:
    """One row per node."""
    lists = rows.column(NODES)
    nodes, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    group = rows.column(GROUP).take(pa.array(np.repeat(np.arange(rows.num_rows), sizes)))
    return pa.RecordBatch.from_arrays([group, *nodes.flatten()], names=[GROUP, *(f.name for f in nodes.type)])


def fold(nodes: DataFrame, size: int, signed: bool, roots: bool = False) -> DataFrame:
    """``nodes``, one row each, with ``print``; with ``roots`` only those without parent. A group comes together in one task, some whole
    groups at a time; rows that lie that way, in order, are neither shuffled nor sorted again.
    """
    many = packed(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            rows = unpacked(rows) if many else rows
            found, done = texts(rows, size, signed)
            if roots:
                done &= rows.column("parent").is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(done)
            out = rows if len(at) == rows.num_rows else rows.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([found[i] for i in at.tolist()], pa.string())], names=[*rows.schema.names, "print"])

    fields = [nodes.schema[GROUP], *nodes.schema[NODES].dataType.elementType.fields] if many else nodes.schema.fields
    schema = T.StructType([*fields, T.StructField("print", T.StringType())])
    return nodes.repartition(GROUP).sortWithinPartitions(GROUP).mapInArrow(run, schema)
