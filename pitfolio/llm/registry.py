"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from . import ann, embed_dedup, filter_audit, jaccard_join, langid, license_scan, mixing, packing, pii, quality, suffix_tree_lm, token_align, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_ann": ann.op2_ann,
    "op3_quality": quality.op3_quality,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_suffix_tree_lm": suffix_tree_lm.op5_suffix_tree_lm,
    "op6_pii": pii.op6_pii,
    "op7_langid": langid.op7_langid,
    "op8_embed_dedup": embed_dedup.op8_embed_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_token_align": token_align.op12_token_align,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
SQL = {
    "op4_jaccard_join": jaccard_join.SQL,
    "op8_embed_dedup": embed_dedup.SQL,
    "op11_license_scan": license_scan.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
