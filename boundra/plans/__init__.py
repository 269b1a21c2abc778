"""Registered driver queries, grouped by topic."""

from __future__ import annotations

from boundra.plans.registry import ORACLES, QUERIES


def load_queries():
    """Every register query and its oracle."""
    from boundra.plans import catalog_queries, ingest_queries, register_queries, spatial_queries, text_queries  # noqa: F401

    return QUERIES, ORACLES
