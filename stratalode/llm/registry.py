"""Queries and oracle SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from . import decontaminate, jaccard_join, mixing, oracles, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, token_store, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_sharding": sharding.query,
    "op5_token_store": token_store.query,
    "op6_mixing": mixing.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_quality_rules": quality_rules.query,
    "op10_decontaminate": decontaminate.query,
}

ORACLES = {
    "op1_warc": oracles.OP1,
    "op3_substring_dedup": oracles.OP3,
    "op8_jaccard_join": oracles.OP8,
    "op10_decontaminate": oracles.OP10,
    "op9_quality_rules": quality_rules.ORACLE,
}
