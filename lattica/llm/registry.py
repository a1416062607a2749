"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lattica.llm import alignment, chat, clustering, exact, mixing, packing, pieces, quality, simhash, substrings, tokens, urls, weak

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_suffix_dedup": substrings.op3_suffix_dedup,
    "op4_quality_classifier": weak.op4_quality_classifier,
    "op5_url_filter": urls.op5_url_filter,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_simhash": simhash.op7_simhash,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_chat_format": chat.op9_chat_format,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_clustering": clustering.op11_clustering,
    "op12_alignment": alignment.op12_alignment,
    "op13_packing": packing.op13_packing,
}
SQL = {"op6_mix_sources": mixing.OP6_SQL, "op9_chat_format": chat.OP9_SQL, "op10_exact_dedup": exact.OP10_SQL, "op11_clustering": clustering.OP11_SQL}
