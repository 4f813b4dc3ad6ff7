"""Frames that several later steps read, and plan-time value lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import written


def settled(df: DataFrame) -> DataFrame:
    """Compute a frame that several later steps read once.

    It is written to the shared folder, which survives lost executors, and read back: no row passes through the driver,
    and joins with it are sized by its files.
    """
    return written(df)


def same_keys(keys: list[str], left: str = "l", right: str = "r") -> Column:
    """Null-safe equality of the keys of two aliased frames."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys meet; the keys of the left side are kept once."""
    added = [c for c in right.columns if c not in keys]
    joined = left.alias("l").join(right.alias("r"), same_keys(keys), how)
    return joined.select("l.*", *[F.col(f"r.`{c}`").alias(c) for c in added])


def bounded_values(df: DataFrame, column: str, max_values: int = 1000) -> list:
    """Sorted distinct values for a plan-time list (pivot columns, dummy columns); too many is an error."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"more than {max_values} distinct values in {column!r}; choose a coarser column")
    return sorted(r[0] for r in rows)
