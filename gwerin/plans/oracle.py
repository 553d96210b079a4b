"""DuckDB SQL of the core's queries, by name."""

from __future__ import annotations

from gwerin.plans import catalogue, registry  # noqa: F401 - the catalogue registers


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
