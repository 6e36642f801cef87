"""Queries of quotelake, by name, with the SQL that gives the same rows."""

from __future__ import annotations


def _load() -> tuple[dict, dict]:
    from quotelake import registry
    from quotelake.plans import codes, dashboards, extracted_tables, extraction, headers_and_codes, line_checks, line_items, matched, materials, more_joins, pricing, queues, scans, sku_parts, streams, workflows  # noqa: F401  these register their queries

    return registry.QUERIES, registry.SQL


def queries() -> dict:
    return dict(_load()[0])


def oracle_sql() -> dict[str, str]:
    return dict(_load()[1])
