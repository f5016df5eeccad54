"""The corpus operators' queries and their SQL twins."""

from __future__ import annotations

from brindle.llm import decontamination, exact_dedup, near_dedup, packing, quality, secrets, suffix_dedup, suffix_tree_lm, token_output, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_suffix_tree": suffix_tree_lm.op4_suffix_tree,
        "op5_packing": packing.op5_packing,
        "op6_quality": quality.op6_quality,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_token_output": token_output.op9_token_output,
        "op10_secret_scan": secrets.op10_secret_scan,
    }


def oracle_sql() -> dict:
    return {"op7_exact_dedup": exact_dedup.OP7_SQL, "op8_decontamination": decontamination.OP8_SQL, "op10_secret_scan": secrets.OP10_SQL}
