"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from . import decontaminate, neardup, packing, quality, rans, secrets, sharding, substrings, suffixes, urls

QUERIES = {
    "op1_benchmark_leaks": decontaminate.op1_benchmark_leaks,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_secret_findings": secrets.op3_secret_findings,
    "op4_minimax_shards": sharding.op4_minimax_shards,
    "op5_maximal_repeats": suffixes.op5_maximal_repeats,
    "op6_clean_lines": quality.op6_clean_lines,
    "op7_filter_urls": urls.op7_filter_urls,
    "op8_repeated_passages": substrings.op8_repeated_passages,
    "op9_length_buckets": packing.op9_length_buckets,
    "op10_rans_blocks": rans.op10_rans_blocks,
}
ORACLES = {
    "op1_benchmark_leaks": decontaminate.ORACLE,
    "op4_minimax_shards": sharding.ORACLE,
    "op6_clean_lines": quality.oracle(),
    "op7_filter_urls": urls.ORACLE,
    "op8_repeated_passages": substrings.ORACLE,
}
