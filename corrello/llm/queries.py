"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from corrello.llm.byte_bpe import op4_byte_level_bpe
from corrello.llm.centroid_clusters import OP12_SQL, op12_dual_tree_lloyd
from corrello.llm.chat_format import OP5_SQL, op5_chat_formatting
from corrello.llm.doc_sketch import op11_bottom_k_sketch
from corrello.llm.html_extract import op8_html_extraction
from corrello.llm.lm_scoring import op9_lm_scoring
from corrello.llm.packing import op10_best_fit_packing
from corrello.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from corrello.llm.quality_classifier import op3_quality_classifier
from corrello.llm.quality_rules import op2_quality_rules
from corrello.llm.topk_search import OP1_SQL, op1_topk_search
from corrello.llm.warc import OP7_SQL, op7_warc_round_trip
from corrello.llm.simhash import op6_simhash_near_dedup

QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_byte_level_bpe": op4_byte_level_bpe,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_html_extraction": op8_html_extraction,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_bottom_k_sketch": op11_bottom_k_sketch,
    "op12_dual_tree_lloyd": op12_dual_tree_lloyd,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": OP1_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op7_warc_round_trip": OP7_SQL,
    "op12_dual_tree_lloyd": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
