"""The queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relata.llm import conversations, decontam, langid, licenses, linededup, media, packing, pieces, quality, repair, simhash, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.op1_language_id,
    "op2_quality": quality.op2_quality,
    "op3_chat_format": conversations.op3_chat_format,
    "op4_warc": warc.op4_warc,
    "op5_simhash": simhash.op5_simhash,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_media_webp": media.op9_media_webp,
    "op10_packing": packing.op10_packing,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": conversations.oracle(),
    "op4_warc": warc.oracle(),
    "op7_license_scan": licenses.oracle(),
    "op11_conversation_repair": repair.oracle(),
}
