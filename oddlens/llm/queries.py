"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from oddlens.llm import decontaminate, hard_negatives, html, jaccard, kneser_ney, mixing, periodic, quality, suffix_dedup, token_files, tokens, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_html_extraction": html.op3_html_extraction,
    "op4_mixing": mixing.op4_mixing,
    "op5_lm_scoring": kneser_ney.op5_lm_scoring,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_warc": warc.op10_warc,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_token_files": token_files.op12_token_files,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op2_jaccard_join": jaccard.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
}
