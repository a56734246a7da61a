"""Queries of the training-data operators and their DuckDB oracles."""

from . import chat, lines, media, mixing, near_dedup, packing, pii, quality, suffix_dedup, topk

QUERIES: dict = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_fuzzy_line_dedup": lines.op3_fuzzy_line_dedup,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_harmonic_packing": packing.op7_harmonic_packing,
    "op8_media_columns": media.op8_media_columns,
    "op9_pii_crf": pii.op9_pii_crf,
    "op10_quality_classifier": quality.op10_quality_classifier,
}
ORACLES: dict = {
    "op4_chat_formatting": chat.OP4_SQL,
    "op6_exact_topk": topk.OP6_SQL,
}
