"""All registered corpus queries."""

from __future__ import annotations

from stationlake.llm import (  # noqa: F401
    bpe,
    chat,
    fingerprints,
    hard_negatives,
    language_model,
    line_dedup,
    minhash,
    mixing,
    quality_rules,
    registry,
    spelling,
    substring_dedup,
    suffix_dedup,
    token_counts,
)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
