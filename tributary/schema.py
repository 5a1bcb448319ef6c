"""Tables of a corpus: one row per function, block, edge, instruction, definition, use, expression node and report."""

from __future__ import annotations

from pyspark.sql.types import StructType


VARIABLE = "name STRING, ssa INT, aliased BOOLEAN, type STRING"

SCHEMAS: dict[str, str] = {
    "functions": (
        "func_id BIGINT, sample_id STRING, name STRING, address BIGINT, symbol_type STRING, arch STRING, platform STRING, "
        "return_type STRING, params ARRAY<STRUCT<name: STRING, type: STRING, location: STRING>>"
    ),
    "blocks": ("func_id BIGINT, block STRING, address BIGINT, is_root BOOLEAN"),
    "edges": ("func_id BIGINT, src STRING, dst STRING, kind STRING, cases ARRAY<BIGINT>, ord INT"),
    "instr": ("func_id BIGINT, block STRING, idx INT, kind STRING, opcode STRING, complexity INT, mem_version INT, text STRING"),
    "defs": (f"func_id BIGINT, block STRING, idx INT, var STRING, {VARIABLE}"),
    "uses": (f"func_id BIGINT, block STRING, idx INT, var STRING, {VARIABLE}, n INT"),
    "phi_args": ("func_id BIGINT, block STRING, idx INT, pred_block STRING, arg STRING, is_const BOOLEAN"),
    "expr": (
        "func_id BIGINT, block STRING, idx INT, node_id INT, parent_id INT, pos INT, op STRING, var STRING, value DECIMAL(38,0), "
        "type STRING, size INT, signed BOOLEAN"
    ),
    "sections": ("sample_id STRING, name STRING, start BIGINT, end BIGINT, semantics STRING"),
    "data_vars": ("sample_id STRING, address BIGINT, type STRING, bytes BINARY"),
    "type_members": ("type_id BIGINT, kind STRING, offset INT, member STRING, type STRING"),
    "reports": (
        "id BIGINT, function_name STRING, function_basic_block_count INT, function_size INT, function_arch STRING, "
        "function_platform STRING, sample_hash STRING, sample_name STRING, sample_total_function_count INT, "
        "sample_analysable_function_count INT, tool_commit STRING, frontend_version STRING, max_basic_blocks INT, exception STRING, "
        "traceback STRING, seconds INT, output STRING, is_successful BOOLEAN, timestamp TIMESTAMP"
    ),
}


def schema_of(table: str) -> StructType:
    """The schema of a corpus table; needs a running session."""
    return StructType.fromDDL(SCHEMAS[table])
