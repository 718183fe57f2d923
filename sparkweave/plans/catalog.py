"""All registered queries."""

from __future__ import annotations

from sparkweave.plans import analytics, assistants, models, relational, scalars, search, state, statements
from sparkweave.plans.registry import ORACLES, QUERIES, Query

MODULES = (relational, analytics, scalars, search, models, state, assistants, statements)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
