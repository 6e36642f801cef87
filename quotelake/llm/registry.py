"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from quotelake.llm import chat_format, decontamination, exact_dedup, filter_audit, lexical_search, license_scan, lm_scoring, ngram_jaccard, quality, secret_scan, sentencepieces, substring_dedup, token_counts


def queries() -> dict:
    return {
        "op1_sentencepieces": sentencepieces.op1_sentencepieces,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_ngram_jaccard": ngram_jaccard.op3_ngram_jaccard,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_lm_scoring": lm_scoring.op7_lm_scoring,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_quality": quality.op9_quality,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_substring_dedup": substring_dedup.op12_substring_dedup,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op3_ngram_jaccard": ngram_jaccard.ORACLE,
        "op4_license_scan": license_scan.ORACLE,
        "op7_lm_scoring": lm_scoring.ORACLE,
        "op8_chat_format": chat_format.ORACLE,
        "op10_decontamination": decontamination.ORACLE,
        "op11_lexical_search": lexical_search.ORACLE,
        "op12_substring_dedup": substring_dedup.ORACLE,
        "op13_filter_audit": filter_audit.ORACLE,
    }
