"""Queries of this subpackage, with DuckDB SQL where it can express them."""

from __future__ import annotations

from . import byte_bpe, centroids, decontaminate, langid, merge_dropout, quality_rules, resampling, secrets, sharding, simhash, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_merge_dropout": merge_dropout.query,
    "op3_simhash": simhash.query,
    "op4_language_id": langid.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_decontaminate": decontaminate.query,
    "op7_secrets": secrets.query,
    "op8_quality_rules": quality_rules.query,
    "op9_sharding": sharding.query,
    "op10_token_counts": token_counts.query,
    "op11_byte_bpe": byte_bpe.query,
    "op12_centroids": centroids.query,
    "op13_resampling": resampling.query,
}
ORACLES = {
    "op1_url_filter": url_filter.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op12_centroids": centroids.SQL,
    "op13_resampling": resampling.SQL,
}
