"""The queries of this subpackage and their SQL."""

from certloom.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup, pii, quality, sharding, substring_dedup, url_filter

QUERIES = {
    "op1_feistel_pseudonyms": pii.op1_feistel_pseudonyms,
    "op2_suffix_array_quality": quality.op2_suffix_array_quality,
    "op3_hypergeometric_shuffle": sharding.op3_hypergeometric_shuffle,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_temporal_url_filter": url_filter.op9_temporal_url_filter,
    "op10_ppm_language_id": language_id.op10_ppm_language_id,
}

ORACLE_SQL = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
    "op9_temporal_url_filter": url_filter.OP9_SQL,
}
