"""The queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

from trialspark.llm import bpe, langid, matroska, mixing, quality, simhash, substring_dedup, suffix_dedup, topk, warc

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_simhash": simhash.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_quality": quality.query,
    "op6_warc": warc.query,
    "op7_matroska": matroska.query,
    "op8_byte_bpe": bpe.query,
    "op9_language_id": langid.query,
    "op10_exact_top_k": topk.query,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op10_exact_top_k": topk.ORACLE,
}
