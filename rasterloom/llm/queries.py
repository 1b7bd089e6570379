"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from rasterloom.llm import bpe, conversations, decontaminate, hard_negatives, line_dedup, media, minhash, quality_rules, substring_dedup, suffix_dedup, suffix_tree_lm, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_minhash": minhash.query,
    "op3_decontaminate": decontaminate.query,
    "op4_toxicity": toxicity.query,
    "op5_line_dedup": line_dedup.query,
    "op6_url_filter": url_filter.query,
    "op7_suffix_tree_lm": suffix_tree_lm.query,
    "op8_bpe": bpe.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_media_columns": media.query,
    "op11_quality_rules": quality_rules.query,
    "op12_conversations": conversations.query,
    "op13_hard_negatives": hard_negatives.query,
    # Parts of two of these, held against SQL.
    "lm_base_scores": suffix_tree_lm.base_query,
    "media_payloads": media.payload_query,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_minhash": minhash.SQL,
    "op6_url_filter": url_filter.SQL,
    "op9_suffix_dedup": suffix_dedup.SQL,
    "op11_quality_rules": quality_rules.SQL,
    "op12_conversations": conversations.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
    "lm_base_scores": suffix_tree_lm.BASE_SQL,
    "media_payloads": media.PAYLOAD_SQL,
}
