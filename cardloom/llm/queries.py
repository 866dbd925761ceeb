"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import (
    chat_formatting,
    collocations,
    decontamination,
    html_extraction,
    jaccard_join,
    language_id,
    mixing,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scans,
    token_counts,
)

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_html_extraction": html_extraction.op5_html_extraction,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_chat_formatting": chat_formatting.op7_chat_formatting,
    "op8_secret_scans": secret_scans.op8_secret_scans,
    "op9_language_id": language_id.op9_language_id,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_source_mixing": mixing.op13_source_mixing,
}

ORACLE_SQL: dict[str, str] = {"op7_chat_formatting": chat_formatting.OP7_SQL, "op12_phrase_collocations": collocations.OP12_SQL}
