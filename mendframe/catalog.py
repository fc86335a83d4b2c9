"""Queries of the schema and data-quality operators, with the DuckDB SQL of each."""

from __future__ import annotations

from .plans import catalogs, nested, packages, properties, records, repairs, rules, stores, texts, tools


def queries() -> dict:
    return {**records.QUERIES, **properties.QUERIES, **texts.QUERIES, **tools.QUERIES, **nested.QUERIES, **packages.QUERIES, **rules.QUERIES, **repairs.QUERIES, **stores.QUERIES, **catalogs.QUERIES}


def oracles() -> dict[str, str]:
    return {**records.ORACLES, **properties.ORACLES, **texts.ORACLES, **tools.ORACLES, **nested.ORACLES, **packages.ORACLES, **rules.ORACLES, **repairs.ORACLES, **stores.ORACLES, **catalogs.ORACLES}
