"""All queries over the driver's tables, by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from loreweave.plans import changes, governance, ingestion, relational, retrieval
from loreweave.plans.registry import Query

PARTS = (relational, retrieval, governance, ingestion, changes)


def queries() -> dict[str, Query]:
    return {k: f for part in PARTS for k, f in part.PLANS.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.PLANS.sql.items()}
