"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tracelake.llm import exact_dedup, jaccard_join, language_id, licenses, merkle, mixing, packing, quality, substring_dedup, token_counts, token_files, warc, whitening


def queries() -> dict:
    return {
        "op1_jaccard_join": jaccard_join.op1_jaccard_join,
        "op2_quality": quality.op2_quality,
        "op3_warc": warc.op3_warc,
        "op4_token_files": token_files.op4_token_files,
        "op5_language_id": language_id.op5_language_id,
        "op6_pack": packing.op6_pack,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_merkle": merkle.op11_merkle,
        "op12_whitening": whitening.op12_whitening,
        "op13_licenses": licenses.op13_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard_join.OP1_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op10_substring_dedup": substring_dedup.OP10_SQL,
        "op11_merkle": merkle.OP11_SQL,
    }
