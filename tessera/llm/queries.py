"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import ann, bpe, embedding_dedup, language, licenses, line_dedup, packing, quality, simhash, token_counts


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
        "op4_language": language.op4_language,
        "op5_packing": packing.op5_packing,
        "op6_bpe": bpe.op6_bpe,
        "op7_ann": ann.op7_ann,
        "op8_simhash": simhash.op8_simhash,
        "op9_quality": quality.op9_quality,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict:
    return {"op1_line_dedup": line_dedup.ORACLE, "op3_embedding_dedup": embedding_dedup.ORACLE}
