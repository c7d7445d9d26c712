"""Named queries of the core and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The query that ``entry`` runs.
FLAGSHIP = "books_page"
#: Modules with QUERIES {name: (query, sql or None)}.
MODULES: list[str] = ["relational", "textual", "pipelines", "catalogue", "kernels", "likeness"]


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict = {}
    for m in MODULES:
        for name, pair in importlib.import_module(f"foliospark.plans.{m}").QUERIES.items():
            if name in out:
                raise ValueError(f"two queries are called {name}")
            out[name] = pair
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL, for the queries that have one."""
    return {k: s for k, (_, s) in _all().items() if s}
