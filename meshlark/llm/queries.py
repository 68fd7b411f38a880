"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from meshlark.llm import importance, line_dedup, mixing, near_dedup, pieces, pitman_yor, quality_rules, sharding, telephony, url_filter

_MODULES = (url_filter, pitman_yor, importance, quality_rules, telephony, pieces, line_dedup, near_dedup, mixing, sharding)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
