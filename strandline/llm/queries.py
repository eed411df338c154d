"""The queries of this package and their SQL, by name."""

from . import decontaminate, forest, language, line_dedup, near_dup, packing, ppm, repeats, shards, url_rules

QUERIES = {
    "op1_ppm_score": ppm.op1_ppm_score,
    "op2_url_rules": url_rules.op2_url_rules,
    "op3_mph_shards": shards.op3_mph_shards,
    "op4_prefix_forest": forest.op4_prefix_forest,
    "op5_zstd_language": language.op5_zstd_language,
    "op6_sum_of_squares": packing.op6_sum_of_squares,
    "op7_tensor_minhash": near_dup.op7_tensor_minhash,
    "op8_bucket_pointer": repeats.op8_bucket_pointer,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_spaced_seeds": decontaminate.op10_spaced_seeds,
}
ORACLE_SQL = {
    "op2_url_rules": url_rules.OP2_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}
