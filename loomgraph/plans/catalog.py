"""Registry of the graph engine's queries and their SQL."""

from __future__ import annotations

from loomgraph.plans import graphs, ingestion, more, reads  # noqa: F401  importing a module registers its queries
from loomgraph.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
