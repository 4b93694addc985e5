"""Named queries: a Spark callable and, where SQL can say it, the equivalent check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgate.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


# The check compares rounded values; the bench times the operators without this presentation step.
ROUNDING = {"on": True}


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round double columns the way the check SQL does."""
    if not ROUNDING["on"]:
        return df
    return df.select(
        *[F.round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes]
    )
