"""Registry of queries over the ledger and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from snapledger.sources.fixtures import WITH, Ledger

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: bool = True):
    """Register a function of a Ledger under ``name``; ``sql`` goes on after the ledger's table expressions."""

    def wrap(f: Callable[[Ledger], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
        if sql:
            SQL[name] = (WITH + sql) if ctes else sql
        return f

    return wrap
