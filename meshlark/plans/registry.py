"""All queries on the reference's schemas."""

from __future__ import annotations

from meshlark.plans import catalog_queries, field_queries, file_queries, fixtures, halo_queries, join_queries, mesh_queries, spectra_queries

__all__ = ["catalog_queries", "field_queries", "file_queries", "halo_queries", "join_queries", "mesh_queries", "oracle_sql", "queries", "spectra_queries"]


def queries() -> dict:
    return dict(fixtures.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(fixtures.ORACLES)
