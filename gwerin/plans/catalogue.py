"""All queries of the core, by name."""

from __future__ import annotations

from gwerin.plans import files_queries, join_queries, registry, rules_queries, stats_queries, text_queries  # noqa: F401 - they register


def queries() -> dict:
    return dict(registry.QUERIES)
