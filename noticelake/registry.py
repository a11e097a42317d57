"""All queries of the library with their oracle SQL."""

from __future__ import annotations

from .plans import announcements, decisions, lifecycle, listings, verdicts  # noqa: F401  (they register their queries)
from .plans.queries import ORACLES, QUERIES, Query, q00_new_pages

FLAGSHIP = q00_new_pages


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
