"""The operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, fm_index, importance, mixing, quality_gam, secrets, simhash, suffix_groups, token_align, token_counts, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_chat_format": chat.op2_chat_format,
    "op3_mixing": mixing.op3_mixing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substring_dedup": fm_index.op5_substring_dedup,
    "op6_suffix_dedup": suffix_groups.op6_suffix_dedup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_token_alignment": token_align.op11_token_alignment,
    "op12_importance": importance.op12_importance,
    "op13_quality": quality_gam.op13_quality,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_chat_format": chat.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op10_secret_scan": secrets.ORACLE,
    "op12_importance": importance.ORACLE,
}
