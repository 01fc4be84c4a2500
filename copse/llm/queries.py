"""Registered queries of the text operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_text, kdtree_topk, mixing, pii, quality, sentencepiece_bpe, simhash, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": html_text.op1_html_text,
        "op2_simhash": simhash.op2_simhash,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_pii": pii.op4_pii,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_kdtree_topk": kdtree_topk.op8_kdtree_topk,
        "op9_sentencepiece": sentencepiece_bpe.op9_sentencepiece,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op8_kdtree_topk": kdtree_topk.OP8_SQL}
