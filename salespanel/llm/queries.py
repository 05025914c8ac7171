"""The operators' queries and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from salespanel.llm import (
    chat_format,
    decontaminate,
    fingerprint,
    lm_score,
    merkle,
    mixing,
    ngram_join,
    pages,
    quality,
    sharding,
    substring,
    token_align,
    toxicity,
)

QUERIES = {
    "op1_quality": quality.query,
    "op2_fingerprint": fingerprint.query,
    "op3_ngram_join": ngram_join.query,
    "op4_decontaminate": decontaminate.query,
    "op5_mixing": mixing.query,
    "op6_toxicity": toxicity.query,
    "op7_substring": substring.query,
    "op8_sharding": sharding.query,
    "op9_lm_score": lm_score.query,
    "op10_pages": pages.query,
    "op11_chat_format": chat_format.query,
    "op12_token_align": token_align.query,
    "op13_merkle": merkle.query,
}

ORACLES = {
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_substring": substring.ORACLE,
    "op11_chat_format": chat_format.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
