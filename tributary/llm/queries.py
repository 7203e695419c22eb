"""The operators' queries, by name: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from tributary.llm.chat import op5_chat_format
from tributary.llm.decontaminate import op8_decontaminate
from tributary.llm.html_text import op7_html_text
from tributary.llm.near_dups import op10_near_dups
from tributary.llm.oracles import ORACLES
from tributary.llm.packing import op3_packing
from tributary.llm.quality_classifier import op1_quality_classifier
from tributary.llm.quality_rules import op6_quality_rules
from tributary.llm.source_audit import op12_source_audit
from tributary.llm.substring_index import op9_substring_index
from tributary.llm.suffix_dedup import op4_suffix_dedup
from tributary.llm.token_files import op2_token_files
from tributary.llm.vector_codes import op11_vector_codes
from tributary.llm.vector_links import op13_vector_links

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_files": op2_token_files,
    "op3_packing": op3_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_text": op7_html_text,
    "op8_decontaminate": op8_decontaminate,
    "op9_substring_index": op9_substring_index,
    "op10_near_dups": op10_near_dups,
    "op11_vector_codes": op11_vector_codes,
    "op12_source_audit": op12_source_audit,
    "op13_vector_links": op13_vector_links,
}

__all__ = ["ORACLES", "QUERIES"]
