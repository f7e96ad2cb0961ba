"""The queries of this package, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import co_training, decontaminate, host_rules, mixing, near_dup, repeats, sharding, token_output, toxicity, url_filter

QUERIES = {
    "op1_quality_classifier": co_training.op1_quality_classifier,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_near_duplicates": near_dup.op3_near_duplicates,
    "op4_repeated_passages": repeats.op4_repeated_passages,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality_rules": host_rules.op8_quality_rules,
    "op9_sharding": sharding.op9_sharding,
    "op10_token_output": token_output.op10_token_output,
}
ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_quality_rules": host_rules.ORACLE,
    "op9_sharding": sharding.ORACLE,
}
