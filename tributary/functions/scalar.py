"""Column functions: folding, masks, names, strings. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BIG = "decimal(38,0)"


def _wrapped(name: str, size: int, signed: bool) -> str:
    """SQL: the low ``size`` (up to 64) bits of a whole number, read as signed or unsigned."""
    if size < 64:
        low = f"(CAST({name} AS BIGINT) & {2**size - 1}L)"
        return f"shiftright(shiftleft({low}, {64 - size}), {64 - size})" if signed else low
    span = f"CAST('{2**size}' AS DECIMAL(38,0))"
    low = f"pmod(CAST({name} AS DECIMAL(38,0)), {span})"
    return f"CAST(IF({low} >= {span} / 2, {low} - {span}, {low}) AS DECIMAL(38,0))" if signed else f"CAST({low} AS DECIMAL(38,0))"


def fold_constants(df: DataFrame, op: str, left: str, right: str, name: str, size: int = 32, signed: bool = True, right_size: int | None = None) -> DataFrame:
    """``df`` with ``name``: the value of the operation in column ``op`` on the whole constants ``left`` and ``right``, wrapped to the size.

    Sizes up to 32 bits are worked out as BIGINT, 64 bits as DECIMAL. Division rounds down; a signed remainder is the floor remainder,
    negated for a negative left operand. Null where there is no value: unknown operation, division by zero, negative shift, operands
    of different sizes other than for remainders and shifts. Steps are columns of their own, so that generated code stays small.
    """
    if 32 < size < 64 or size > 64:
        raise ValueError("sizes are at most 32, or 64")
    number = "BIGINT" if size < 64 else "DECIMAL(38,0)"
    half = 16 if size < 64 else 32
    part = f"CAST({2**half} AS {number})"
    out = df.withColumns(
        {
            "_a": F.expr(_wrapped(left, size, True)),
            "_b": F.expr(_wrapped(right, size, True)),
            "_ua": F.expr(_wrapped(left, size, False)),
            "_ub": F.expr(_wrapped(right, size, False)),
            "_n": F.expr(f"CAST(least(greatest({right}, -1), 1000) AS BIGINT)"),
        }
    )
    # what a shift multiplies or divides by
    out = out.withColumn("_p", F.expr(f"CAST(shiftleft(1L, CAST(greatest(least(_n, 62), 0) AS INT)) AS {number})"))
    out = out.withColumn("_own", F.col("_a" if signed else "_ua"))

    def floor(a: str, b: str) -> tuple[str, str]:
        rest = f"({a} % nullif({b}, 0))"
        mod = f"({rest} + IF({rest} <> 0 AND ({rest} < 0) <> ({b} < 0), {b}, 0))"
        whole = f"({a} - {mod})"
        return (f"({whole} div nullif({b}, 0))" if size < 64 else f"CAST({whole} / nullif({b}, 0) AS DECIMAL(38,0))"), mod

    out = out.withColumns({"_q": F.expr(floor("_a", "_b")[0]), "_uq": F.expr(floor("_ua", "_ub")[0])})
    far = f"_n >= {size}"
    strict = {
        "plus": "_a + _b",
        "minus": "_a - _b",
        "multiply": "_a * _b",
        "multiply_us": f"_ua * (_ub % {part}) + (_ua * CAST((_ub - _ub % {part}) / {part} AS {number})) % ({part} * {part}) * {part}"
        if size == 64
        else f"_ua * (_ub & 65535L) + ((_ua * shiftright(_ub, 16)) & {2**size - 1}L) * 65536L",
        "divide": "_q",
        "divide_us": "_uq",
        "bitwise_or": "CAST(_a AS BIGINT) | CAST(_b AS BIGINT)",
        "bitwise_and": "CAST(_a AS BIGINT) & CAST(_b AS BIGINT)",
        "bitwise_xor": "CAST(_a AS BIGINT) ^ CAST(_b AS BIGINT)",
    }
    beyond = "_n > 62" if size == 64 else "false"
    double = "(_p * 2)" if size == 64 else "_p"
    loose = {
        "modulo": f"IF(_a < 0, -1, 1) * {floor('_a', '_b')[1]}",
        "modulo_us": floor("_ua", "_ub")[1],
        # a shift by the size or more leaves nothing but the sign
        "left_shift": f"CASE WHEN {far} THEN 0 WHEN _n >= 0 THEN _own * _p END" if size < 64 else f"CASE WHEN {far} THEN 0 WHEN _n > 62 THEN _own % 2 * _p * 2 WHEN _n >= 0 THEN (_own % (CAST(shiftleft(1L, CAST(62 - _n AS INT)) AS DECIMAL(38,0)) * 4)) * _p END",
        "right_shift": f"CASE WHEN {far} THEN IF(_own < 0, -1, 0) WHEN {beyond} THEN IF(_own < 0, -1, CAST((_own - _own % {double}) / {double} AS {number})) WHEN _n >= 0 THEN {floor('_own', '_p')[0]} END",
        "right_shift_us": f"CASE WHEN {far} THEN 0 WHEN {beyond} THEN CAST((_ua - _ua % {double}) / {double} AS {number}) WHEN _n >= 0 THEN {floor('_ua', '_p')[0]} END",
        "negate": "-_a",
        "bitwise_not": "-_a - 1",
    }
    same = right_size is None or right_size == size
    cases = " ".join(f"WHEN '{k}' THEN CAST({v} AS {number})" for k, v in {**(strict if same else {}), **loose}.items())
    out = out.withColumn("_v", F.expr(f"CASE {op} {cases} END")).withColumn(name, F.expr(_wrapped("_v", size, signed)))
    return out.drop("_a", "_b", "_ua", "_ub", "_n", "_p", "_own", "_q", "_uq", "_v")


def bit_positions(mask: Column) -> Column:
    """Ascending positions of the set bits of a 64-bit mask; the sign is bit 63."""
    places = F.array(*[F.lit(i) for i in range(64)])
    return F.filter(places, lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)


LONGEST_NAME = 64


def clean_name(name: Column, address: Column) -> Column:
    """A name usable as identifier: no quotes and backticks, underscores for spaces and dots; by address where mangled or too long."""
    plain = F.translate(F.translate(name, "'\"`", ""), " .", "__")
    unusable = name.startswith("??") | (F.length(name) > LONGEST_NAME)
    return F.when(unusable, F.concat(F.lit("data_"), F.lower(F.hex(address)))).otherwise(plain)


PRINTABLE = r"[\t\n\r\x20-\x7e]"


def printable_string(raw: Column, widths: Sequence[int] = (1, 2, 4)) -> Column:
    """struct(text, width): the zero-terminated text at the start of binary ``raw``, by the first width that gives one; else null.

    Units are little-endian and must be printable ASCII, tab, line feed or carriage return; the end of the data also ends the text. Its
    written form needs two characters, which an escaped control character or backslash has by itself.
    """
    out = F.lit(None).cast("struct<text:string,width:int>")
    chars = F.decode(raw, "ISO-8859-1")
    for width in reversed(widths):
        if width == 1:
            text = F.substring_index(chars, "\0", 1)
        else:
            end = rf"(?:\x00{{{width}}}|[\s\S]{{0,{width - 1}}}$)"
            units = F.regexp_extract(chars, rf"^((?:{PRINTABLE}\x00{{{width - 1}}})+){end}", 1)
            text = F.translate(units, "\0", "")
        written = F.length(F.regexp_replace(text, r"[\t\n\r\\]", "xx"))
        good = text.rlike(rf"^{PRINTABLE}+$") & ~text.endswith("\0") & (written >= 2)
        out = F.when(good, F.struct(text.alias("text"), F.lit(width).alias("width"))).otherwise(out)
    return out
