"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import kneser_ney, license_scan, line_dedup, ngram_join, packing, pieces, quality_rules, quote_links, url_filter, vector_forest

MODULES = [quality_rules, vector_forest, quote_links, kneser_ney, license_scan, line_dedup, packing, url_filter, ngram_join, pieces]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
