"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestrand.llm import chat, embeddings, exact_dedup, jaccard, mixing, packing, quality, substrings, suffixes, toxicity


def queries() -> dict:
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op10_toxicity": toxicity.op10_toxicity,
        "op2_substring_dedup": substrings.op2_substring_dedup,
        "op3_suffix_dedup": suffixes.op3_suffix_dedup,
        "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_chat_rotation": chat.op6_chat_rotation,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_embedding_range_join": embeddings.op8_embedding_range_join,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_rotation": chat.OP6_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL}
