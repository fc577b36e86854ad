"""The corpus operators' queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkprep.llm import chat_format, jaccard_join, language_id, line_dedup, merkle, mixing, phrases, piece_dropout, quality_model, substring_dedup, topk, url_rules, weak_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_piece_dropout": piece_dropout.op2_piece_dropout,
        "op3_url_rules": url_rules.op3_url_rules,
        "op4_language_id": language_id.op4_language_id,
        "op5_quality_model": quality_model.op5_quality_model,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_exact_top_k": topk.op7_exact_top_k,
        "op8_weak_rules": weak_rules.op8_weak_rules,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_phrases": phrases.op12_phrases,
        "op13_chat_format": chat_format.op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op6_mix_sources": mixing.ORACLE_SQL,
        "op7_exact_top_k": topk.ORACLE_SQL,
        "op9_substring_dedup": substring_dedup.ORACLE_SQL,
        "op11_merkle_manifest": merkle.ORACLE_SQL,
        "op12_phrases": phrases.ORACLE_SQL,
        "op13_chat_format": chat_format.ORACLE_SQL,
    }
