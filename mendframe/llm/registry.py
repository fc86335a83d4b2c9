"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import alignment, attribution, clusters, fingerprint, html_extract, line_dedup, media, mixing, ngram_join, packing, sharding, token_store, toxicity

MODULES = [mixing, media, ngram_join, attribution, line_dedup, toxicity, packing, html_extract, fingerprint, token_store, clusters, alignment, sharding]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
