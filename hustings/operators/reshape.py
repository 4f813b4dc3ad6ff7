"""Unions, unpivots and matrices (ST1-ST4, RS1-RS4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sizing import bounded_values


def union_all(*frames: DataFrame) -> DataFrame:
    """ST1: same-schema frames; columns missing from one become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_union(parts: dict[str, tuple[DataFrame, dict[str, str]]], columns: list[str], tag: str) -> DataFrame:
    """ST2: rename each part to the common columns, label it, append."""
    return union_all(
        *[df.withColumnsRenamed(names).select(*columns, F.lit(label).alias(tag)) for label, (df, names) in parts.items()]
    )


def label_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """ST4."""
    return a.select(column).where(F.col(column).isNotNull()).subtract(b.select(column))


def melt_measures(df: DataFrame, ids: list[str], measures: list[str], name: str = "measure", value: str = "value") -> DataFrame:
    """RS1."""
    return df.unpivot(ids, measures, name, value)


def fixed_matrix(df: DataFrame, row: str, rows: list[str], column: str, columns: list, value: str) -> DataFrame:
    """RS2: matrix with rows and columns in a given order; absent cells are NULL, absent rows stay."""
    order = df.sparkSession.createDataFrame([(r, i) for i, r in enumerate(rows)], f"{row} string, row_order int")
    wide = df.groupBy(row).pivot(column, columns).agg(F.first(value))
    return order.join(wide, row, "left").orderBy("row_order")


def entity_cycle_matrix(
    df: DataFrame, value: str, entity: str = "country", cycle: str = "election_year", cycles: list | None = None
) -> DataFrame:
    """RS3: one row per entity, one column per cycle, empty cells NULL."""
    cycles = cycles or bounded_values(df, cycle)
    return df.groupBy(entity).pivot(cycle, cycles).agg(F.first(value))


def metric_matrix(metrics: DataFrame, rows: list[str], names: list[str]) -> DataFrame:
    """RS4: configurations by metric."""
    return metrics.groupBy(*rows).pivot("metric", names).agg(F.first("value"))
