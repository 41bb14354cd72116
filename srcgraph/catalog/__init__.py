"""Registered queries: each a Spark callable and, where SQL can say the same, its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load() -> None:
    """Import every catalog module once; importing registers its queries."""
    from srcgraph.catalog import (  # noqa: F401
        answers,
        code,
        corpus,
        evaluation,
        graph,
        incremental,
        interaction,
        questions,
        retrieval,
    )
