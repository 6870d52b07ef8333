"""The queries of the training-data operators, by name."""

from __future__ import annotations

from . import bpe, line_dedup, media, neighbours, packing, simhash, suffix_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_media": media.op6_media,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe": bpe.op10_bpe,
}
ORACLES = {"op7_line_dedup": line_dedup.ORACLE}
