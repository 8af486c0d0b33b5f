"""Where plan modules enter their queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.domain import cte

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Enter a query under ``name``; ``sql`` may use the named domain views."""

    def enter(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = cte(views, sql)
        return query

    return enter


def sql_lakhs(x: str) -> str:
    return f"CAST(round(CAST(({x}) / 100000.0::DOUBLE AS DECIMAL(28,9)), 2) AS DOUBLE)"


def sql_percent(part: str, whole: str, digits: int = 1) -> str:
    return f"CAST(round(CAST(({part})::DOUBLE * 100 / (CASE WHEN coalesce({whole}, 0) = 0 THEN 1 ELSE {whole} END)::DOUBLE AS DECIMAL(28,9)), {digits}) AS DOUBLE)"
