"""Queries by name, each with its DuckDB SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Pixels of the frames that the embeddings are taken for: 8 x 8, row-major, label as extension.
PX = """px AS (SELECT vec_id AS frame_idx, label AS ext, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
    CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i))"""


def r6(x: str) -> str:
    """Rounded to 6 places, without a negative zero."""
    return f"(CASE WHEN abs({x}) < 5e-7 THEN CAST(0 AS DOUBLE) ELSE round({x}, 6) END)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add
