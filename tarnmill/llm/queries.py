"""The queries of this subpackage, by name, and their DuckDB twins."""

from __future__ import annotations

from tarnmill.llm import arc_convert, chat_format, licence_scan, line_dedup, line_quality, mixing, near_dedup, phrase_index, pii_bootstrap, prefix_trie
from tarnmill.llm import secret_scan, set_relations, vector_codes

_ALL = {
    "op1_mixing": (mixing.op1_mixing, mixing.OP1_SQL),
    "op2_arc_convert": (arc_convert.op2_arc_convert, arc_convert.OP2_SQL),
    "op3_near_dedup": (near_dedup.op3_near_dedup, near_dedup.OP3_SQL),
    "op4_licence_scan": (licence_scan.op4_licence_scan, licence_scan.OP4_SQL),
    "op5_pii_bootstrap": (pii_bootstrap.op5_pii_bootstrap, None),
    "op6_line_quality": (line_quality.op6_line_quality, line_quality.OP6_SQL),
    "op7_secret_scan": (secret_scan.op7_secret_scan, secret_scan.OP7_SQL),
    "op8_line_dedup": (line_dedup.op8_line_dedup, line_dedup.OP8_SQL),
    "op9_phrase_index": (phrase_index.op9_phrase_index, phrase_index.OP9_SQL),
    "op10_chat_format": (chat_format.op10_chat_format, chat_format.OP10_SQL),
    "op11_set_join": (set_relations.op11_set_join, set_relations.OP11_SQL),
    "op12_prefix_trie": (prefix_trie.op12_prefix_trie, prefix_trie.OP12_SQL),
    "op13_vector_codes": (vector_codes.op13_vector_codes, vector_codes.OP13_SQL),
}


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
