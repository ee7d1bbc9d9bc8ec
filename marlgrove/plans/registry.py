"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from . import agentic, analytics, composing, corpus, drafting, rag, relational, retrieval, scores, stores, streams, writing  # noqa: F401
