"""All registered queries of the core."""

from __future__ import annotations

from vecloom.plans import attention, extras, logs, status, streams, tail, text  # noqa: F401  (modules register their queries)
from vecloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
