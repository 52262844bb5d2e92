"""The queries of this subpackage over the given tables, and SQL where it can express them."""

from __future__ import annotations

from tidemark.llm import (
    bpe,
    clustering,
    decontaminate,
    exact_dedup,
    html_extract,
    importance,
    jaccard_join,
    line_dedup,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filter,
    whitening,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_importance": importance.op7_importance,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_clustering": clustering.op11_clustering,
    "op12_whitening": whitening.op12_whitening,
    "op13_url_filter": url_filter.op13_url_filter,
}
ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op11_clustering": clustering.SQL,
    "op13_url_filter": url_filter.SQL,
}
