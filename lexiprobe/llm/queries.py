"""The queries of this subpackage, one per operator, each over its whole table."""

from __future__ import annotations

from lexiprobe.llm import ann, byte_bpe, exact_dedup, fill_middle, jaccard, line_dedup, mixing, pii, quality, substring_dedup, token_files, toxicity, whitening


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_exact_dedup": exact_dedup.op2,
        "op3_mixing": mixing.op3,
        "op4_substring_dedup": substring_dedup.op4,
        "op5_ann": ann.op5,
        "op6_jaccard": jaccard.op6,
        "op7_quality": quality.op7,
        "op8_line_dedup": line_dedup.op8,
        "op9_pii": pii.op9,
        "op10_byte_bpe": byte_bpe.op10,
        "op11_fill_middle": fill_middle.op11,
        "op12_whitening": whitening.op12,
        "op13_token_files": token_files.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op4_substring_dedup": substring_dedup.OP4_SQL,
        "op6_jaccard": jaccard.OP6_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op11_fill_middle": fill_middle.OP11_SQL,
    }
