"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tributary.llm import (
    avi_mjpeg, benchmark_automaton, chat_layouts, license_diagonals, line_rules, pareto_mix, piece_trie, quality_qda, signature_tree, source_trees,
    square_catchers, token_files, warc_chain,
)

QUERIES = {
    "op1_chat_layouts": chat_layouts.query,
    "op2_avi_mjpeg": avi_mjpeg.query,
    "op3_token_files": token_files.query,
    "op4_quality_discriminant": quality_qda.query,
    "op5_line_rules": line_rules.query,
    "op6_signature_tree": signature_tree.query,
    "op7_license_diagonals": license_diagonals.query,
    "op8_piece_trie": piece_trie.query,
    "op9_warc_chain": warc_chain.query,
    "op10_pareto_mix": pareto_mix.query,
    "op11_square_catchers": square_catchers.query,
    "op12_source_trees": source_trees.query,
    "op13_benchmark_automaton": benchmark_automaton.query,
}

ORACLES = {
    "op1_chat_layouts": chat_layouts.ORACLE,
    "op10_pareto_mix": pareto_mix.ORACLE,
    "op12_source_trees": source_trees.ORACLE,
    "op13_benchmark_automaton": benchmark_automaton.ORACLE,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
