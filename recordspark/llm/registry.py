"""The queries of the corpus operators."""

from __future__ import annotations

from recordspark.llm import chat, embedding_links, language_model, mixing, near_duplicates, packing, quality, repeated_passages, secrets, token_files


def queries() -> dict:
    return {
        "op1_embedding_links": embedding_links.query,
        "op2_secret_scan": secrets.query,
        "op3_token_files": token_files.query,
        "op4_language_model": language_model.query,
        "op5_host_quality": quality.query,
        "op6_near_duplicates": near_duplicates.query,
        "op7_chat_windows": chat.query,
        "op8_poisson_mixing": mixing.query,
        "op9_balanced_packing": packing.query,
        "op10_repeated_passages": repeated_passages.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_poisson_mixing": mixing.ORACLE}
