"""All queries of the reference's operators and their SQL twins."""

from __future__ import annotations

from trovex.plans import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLES)
