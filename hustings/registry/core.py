"""Registry of driver queries: a Spark callable, the operator IDs it covers, and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    ids: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = Query(fn, tuple(ids.split()), sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show; a negative zero becomes zero."""
    floats = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in floats})
