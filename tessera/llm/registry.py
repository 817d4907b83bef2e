"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import alignment, bpe, chat, class_lm, decontam, embed_dup, langid, near_dup, pii, sharding, token_counts, token_files, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_class_lm": class_lm.op2_class_lm,
        "op3_embedding_dedup": embed_dup.op3_embedding_dedup,
        "op4_near_duplicates": near_dup.op4_near_duplicates,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_chat_format": chat.op6_chat_format,
        "op7_language_id": langid.op7_language_id,
        "op8_pii": pii.op8_pii,
        "op9_token_files": token_files.op9_token_files,
        "op10_sharding": sharding.op10_sharding,
        "op11_whitening": whitening.op11_whitening,
        "op12_token_counts": token_counts.op12_token_counts,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are tested against brute force or their library."""
    return {"op3_embedding_dedup": embed_dup.OP3_SQL, "op6_chat_format": chat.OP6_SQL}
