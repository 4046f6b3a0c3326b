"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB statements."""

from __future__ import annotations

from doctables.llm import (
    chat_format, collocations, decontaminate, mixing, ngram_join, packing, quality_rules, repeats, secret_scan, token_counts, toxicity, trie, url_filter)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_suffix_array_dedup": repeats.op2_suffix_array_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_mix_sources": mixing.op11_mix_sources,
    "op12_collocations": collocations.op12_collocations,
    "op13_conversation_trie": trie.op13_conversation_trie,
}

SQL = {
    "op4_url_filter": url_filter.SQL,
    "op7_secret_scan": secret_scan.SQL,
    "op10_chat_format": chat_format.SQL,
    "op11_mix_sources": mixing.SQL,
    "op12_collocations": collocations.SQL,
    "op13_conversation_trie": trie.SQL,
}
