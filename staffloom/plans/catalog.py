"""How queries are registered: a function of the recruiting tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffloom.fixtures import Tables
from staffloom.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return put


def stamp(column: str, name: str | None = None) -> Column:
    """A time as text."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or column)


def joined(column: str, name: str | None = None) -> Column:
    """An array as text."""
    return F.array_join(column, "|").alias(name or column)
