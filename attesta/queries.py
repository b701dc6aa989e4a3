"""Registry of the queries over claims, evidence, sources, drafts and manifests."""

from __future__ import annotations

from collections.abc import Callable

from attesta.plans import brief_queries, claim_queries, corpus_queries, draft_queries, export_queries, manifest_queries, registry, review_queries, route_queries, rule_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
