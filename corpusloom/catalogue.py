"""All registered queries of the library proper and their DuckDB equivalents."""

from __future__ import annotations

from corpusloom import registry
from corpusloom.plans import compose, evaluate, ingest, operate, retrieve  # noqa: F401  registers their queries

FLAGSHIP = "hybrid_search"


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
