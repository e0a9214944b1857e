"""The text queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import context_mixing, exact_dedup, jaccard_join, langid, packing, pii, sentencepiece_lattice, suffix_dedup, topk_search, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": jaccard_join.op1_ngram_jaccard,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_language": langid.op4_language,
        "op5_lm_scores": context_mixing.op5_lm_scores,
        "op6_packing": packing.op6_packing,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_topk_search": topk_search.op8_topk_search,
        "op9_pii": pii.op9_pii,
        "op10_sentencepiece": sentencepiece_lattice.op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": jaccard_join.SQL, "op2_exact_dedup": exact_dedup.SQL, "op7_suffix_dedup": suffix_dedup.SQL, "op8_topk_search": topk_search.SQL}
