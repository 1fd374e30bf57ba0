"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the function below as ``name``, with its SQL if SQL can express it."""

    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


def flat(column):
    """An array as one sorted, comparable string."""
    return F.array_join(F.array_sort(column), " ")


def load() -> None:
    """Import the modules that register queries."""
    from turnloom.plans import dates, lattice, memory, search, text, upkeep  # noqa: F401
