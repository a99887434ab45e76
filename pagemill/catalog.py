"""The library's queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from pagemill.plans import control, jobs, live, more, registry, texts, titles  # noqa: F401  importing registers


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
