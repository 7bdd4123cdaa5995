"""Queries of this subpackage, with SQL where SQL expresses them."""

from __future__ import annotations

from . import decontaminate, fingerprints, html_text, near_dedup, packing, quality, sharding, substring_dedup, suffix_tree_lm, warc

QUERIES = {
    "op1_lpt_sharding": sharding.op1_lpt_sharding,
    "op9_spaced_seed_decontamination": decontaminate.op9_spaced_seed_decontamination,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op2_pfp_substring_dedup": substring_dedup.op2_pfp_substring_dedup,
    "op3_suffix_tree_lm": suffix_tree_lm.op3_suffix_tree_lm,
    "op4_host_suffix_array": html_text.op4_host_suffix_array,
    "op5_order_minhash": fingerprints.op5_order_minhash,
    "op6_grouping_ga_packing": packing.op6_grouping_ga_packing,
    "op7_knn_quality": quality.op7_knn_quality,
    "op8_warc": warc.op8_warc,
}
ORACLES: dict[str, str] = {
    "op9_spaced_seed_decontamination": decontaminate.ORACLE,
    "op10_minhash_near_dedup": near_dedup.ORACLE,
    "op8_warc": warc.ORACLE,
}
