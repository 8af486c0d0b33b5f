"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from ledgerloom.llm import bit_packed, co_training, jaccard_join, language_id, license_scan, motion_jpeg, packing, quality_rules, sources_mix, url_reputation

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_mixture_packing": packing.query,
    "op3_license_scan": license_scan.query,
    "op4_motion_jpeg": motion_jpeg.query,
    "op5_url_reputation": url_reputation.query,
    "op6_jaccard_join": jaccard_join.query,
    "op7_bit_packed_ids": bit_packed.query,
    "op8_language_id": language_id.query,
    "op9_co_training": co_training.query,
    "op10_source_mix": sources_mix.query,
}

ORACLES = {
    "op3_license_scan": license_scan.ORACLE,
    "op5_url_reputation": url_reputation.ORACLE,
    "op10_source_mix": sources_mix.ORACLE,
}
