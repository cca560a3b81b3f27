"""The registered corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderglass.llm import (
    decontamination, exact_dedup, filter_audit, html_text, language_id, license_scan, mixing, near_dedup, packing, quality,
    ranked_search, substring_dedup, url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_html_text": html_text.op3_html_text,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_language_id": language_id.op9_language_id,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_decontamination": decontamination.op12_decontamination,
        "op13_ranked_search": ranked_search.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": exact_dedup.ORACLE, "op11_filter_audit": filter_audit.ORACLE,
        "op12_decontamination": decontamination.ORACLE, "op13_ranked_search": ranked_search.ORACLE,
    }
