"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: query -> module of this subpackage that holds it
MODULES = {
    "op3_substring_dedup": "substring_dedup",
    "op1_url_filter": "url_filter",
    "op4_simhash_near_duplicates": "simhash",
    "op5_bpe": "bpe",
    "op6_language_id": "langid",
    "op8_bm25_top_k": "search",
    "op9_line_chunk_dedup": "line_dedup",
    "op2_quality_rules": "quality",
    "op7_secret_scan": "secret_scan",
    "op10_mix_sources": "mixing",
    "op11_collocations": "collocations",
    "op12_filter_audit": "filter_audit",
    "op13_decontaminate": "decontaminate",
    # What SQL can express of operators whose verdicts it can't.
    "llm_url_rules": "url_filter",
    "llm_quality_base": "quality",
    "llm_secret_base": "secret_scan",
}


def queries() -> dict[str, Callable]:
    return {name: getattr(importlib.import_module(f"attesta.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in sorted(set(MODULES.values())):
        found |= getattr(importlib.import_module(f"attesta.llm.{module}"), "ORACLE_SQL", {})
    return found
