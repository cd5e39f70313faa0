"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from skein.llm import exact_dedup, line_dedup, line_quality, mixing, packing, secret_scan, simhash, suffix_dedup, suffix_tree_lm, token_counts

QUERIES = {
    "op1_run_length_index": suffix_dedup.op1,
    "op2_power_of_two_packing": packing.op2,
    "op3_suffix_tree_lm": suffix_tree_lm.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_edited_token_counts": token_counts.op5,
    "op6_mix_sources": mixing.op6,
    "op7_simhash_anchors": simhash.op7,
    "op8_secret_scan": secret_scan.op8,
    "op9_line_quality": line_quality.op9,
    "op10_exact_dedup": exact_dedup.op10,
}
ORACLE_SQL = {
    "op6_mix_sources": mixing.OP6_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
