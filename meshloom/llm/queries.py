"""The queries of this subpackage, and DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from meshloom.llm import exact_dedup, html_text, license_scan, line_dedup, lm_scoring, mixing, ngram_join, packing, periodic_runs, pii, quality_rules, token_alignment, token_counts


def queries() -> dict[str, Callable]:
    return {
        "op1_html_extraction": html_text.op1_html_extraction,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_mixing": mixing.op6_mixing,
        "op7_lm_scoring": lm_scoring.op7_lm_scoring,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_pii": pii.op9_pii,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_license_scan": license_scan.op12_license_scan,
        "op13_token_alignment": token_alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op4_line_dedup": line_dedup.ORACLE}
