"""All queries of the engine by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from starloom.plans import command_queries, linalg_queries, loading_queries, more_queries, pixel_queries, registry, selection_queries, table_queries  # noqa: F401  they register their queries


def queries() -> dict[str, Callable]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def FLAGSHIP(spark, sf_dir):  # noqa: N802
    return registry.QUERIES["klip_covariance"](spark, sf_dir)
