"""The registered queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from cairn.llm import chat, decontaminate, langid, media, mixture, neardup, quality, spans, warc, wrapper

QUERIES = {
    "op1_chat_format": chat.query,
    "op2_substring_dedup": spans.query,
    "op3_media_hash": media.query,
    "op4_decontamination": decontaminate.query,
    "op5_simhash_neardup": neardup.query,
    "op6_wrapper_induction": wrapper.query,
    "op7_language_id": langid.query,
    "op8_warc_zstd": warc.query,
    "op9_quality_classifier": quality.query,
    "op10_source_mixture": mixture.query,
}

SQL = {
    "op1_chat_format": chat.SQL,
    "op2_substring_dedup": spans.SQL,
    "op8_warc_zstd": warc.SQL,
    "op10_source_mixture": mixture.SQL,
}
