"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from stowage.llm import best_fit_packing, decontamination, exact_dedup, html_text, licenses, near_join, quality, quotation, toxicity, warc

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality": quality.op3_quality,
    "op4_best_fit_packing": best_fit_packing.op4_best_fit_packing,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_quotation": quotation.op6_quotation,
    "op7_licenses": licenses.op7_licenses,
    "op8_ngram_jaccard_join": near_join.op8_ngram_jaccard_join,
    "op9_warc": warc.op9_warc,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_ngram_jaccard_join": near_join.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
}
