"""Names of queries, what they run and the SQL that they equal."""

from __future__ import annotations

from .plans import papers as _papers  # noqa: F401  registers its queries
from .plans import queries as _plans
from .plans import series as _series  # noqa: F401

flagship = _plans.flagship


def queries() -> dict[str, _plans.Query]:
    return dict(_plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_plans.SQL)
