"""Queries and SQL of the training-data operators, for the entry point."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, gif, jaccard_join, packing, ppm, toxicity, url_filter, warc

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_pattern_packing": packing.op2_pattern_packing,
    "op3_chat_format": chat.op3_chat_format,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_gif_media": gif.op6_gif_media,
    "op7_bpe_codec": bpe.op7_bpe_codec,
    "op8_ppm_score": ppm.op8_ppm_score,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL = {
    "op3_chat_format": chat.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op9_url_filter": url_filter.SQL,
    "op10_warc": warc.SQL,
}
