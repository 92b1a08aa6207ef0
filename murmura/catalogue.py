"""The catalogue of registered queries."""

from __future__ import annotations

from .plans import QUERIES, SQL, covering, evaluating, features, learning, preparing, relating, sampling  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
