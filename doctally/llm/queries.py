"""The registered queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from . import decontaminate, language_id, media, near_dedup, packing, phrases, pivot_search, prefix_trie, secrets, tool_calls, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_media_columns": media.op4_media_columns,
        "op5_warc": warc.op5_warc,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_secrets": secrets.op8_secrets,
        "op9_tool_calls": tool_calls.op9_tool_calls,
        "op10_packing": packing.op10_packing,
        "op11_phrases": phrases.op11_phrases,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_pivot_search": pivot_search.op13_pivot_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": url_filter.ORACLE, "op9_tool_calls": tool_calls.ORACLE, "op11_phrases": phrases.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_pivot_search": pivot_search.ORACLE}
