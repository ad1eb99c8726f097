"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quern.llm import byte_bpe, hard_negatives, jaccard_join, language_id, license_scan, line_dedup, media, mixing, quality, suffix_dedup, token_counts, toxicity, vector_codes

    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_mixing": mixing.op6_mixing,
        "op7_media": media.op7_media,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_language_id": language_id.op10_language_id,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_license_scan": license_scan.op12_license_scan,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracles() -> dict[str, str]:
    from quern.llm import hard_negatives, vector_codes

    return {"op11_vector_codes": vector_codes.OP11_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
