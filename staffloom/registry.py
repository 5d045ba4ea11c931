"""All queries of the recruiting library by name, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from staffloom.plans import audit, matching, people, questions, resume_text, scalars, scheduling  # noqa: F401
from staffloom.plans.catalog import ORACLES, QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
