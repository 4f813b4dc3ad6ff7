"""Data-quality checks (QC1-QC9).

Each check returns the offending rows (or one row of figures); ``require_empty`` turns a check into a gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ENTITY_CYCLE


class QualityError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """QC1."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def wrong_winner_counts(df: DataFrame, keys: list[str] = ENTITY_CYCLE, flag: str = "is_winner") -> DataFrame:
    """QC2: cycles without exactly one winner."""
    return df.groupBy(*keys).agg(F.sum(flag).alias("winners")).where(F.col("winners") != 1)


def after_cutoff(df: DataFrame, date: str = "last_poll_date", cutoff: str = "election_date") -> DataFrame:
    """QC3."""
    return df.where(F.col(date) > F.col(cutoff))


def uncovered(expected: DataFrame, covered: DataFrame, keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """QC4 / JN5: expected keys that the other frame lacks."""
    return expected.select(*keys).distinct().join(covered.select(*keys).distinct(), keys, "left_anti")


def invalid_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """QC5: counts of missing and infinite values per numeric column."""
    counts = []
    for c in columns:
        v = F.col(c).cast("double")
        counts.append(F.count_if(v.isNull() | F.isnan(v)).alias(f"{c}|missing"))
        counts.append(F.count_if(F.abs(v) == float("inf")).alias(f"{c}|infinite"))
    wide = df.agg(*counts)
    parts = ", ".join(f"'{c}', `{c}|missing`, `{c}|infinite`" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {parts}) as (column_name, missing, infinite)")


def outside_split(df: DataFrame, split: str, column: str = "dataset_split") -> DataFrame:
    """QC6: rows of any other split, unlabelled ones included."""
    return df.where(~F.col(column).eqNullSafe(split))


def expected_totals(df: DataFrame, totals: dict[str, int], keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """QC7: rows, distinct keys and entities against the figures passed by the caller."""
    found = {
        "rows": F.count("*"),
        "cycles": F.count_distinct(*[F.col(k) for k in keys]),
        "entities": F.count_distinct(keys[0]),
    }
    wide = df.agg(*[found[name].alias(name) for name in totals])
    parts = ", ".join(f"'{name}', `{name}`, cast({int(n)} as bigint)" for name, n in totals.items())
    return wide.selectExpr(f"stack({len(totals)}, {parts}) as (figure, found, expected)").where("found <> expected")


def error_consistency(df: DataFrame, signed: str, absolute: str) -> DataFrame:
    """QC8: largest gap between an absolute error and the signed error's size."""
    return df.agg(F.max(F.abs(F.abs(F.col(signed)) - F.col(absolute))).alias("max_gap"))


def anchor_check(df: DataFrame, anchors: DataFrame, keys: list[str], value: str, tolerance: float = 0.1) -> DataFrame:
    """QC9: known published figures (``expected``) against computed ones; NULL when the key is absent."""
    found = anchors.join(df.select(*keys, value), keys, "left")
    return found.withColumn("within", F.abs(F.col(value) - F.col("expected")) <= tolerance)


def require_empty(check: DataFrame, message: str, show: int = 20) -> None:
    """Run a check now; its first rows go into the error text."""
    rows = check.limit(show).collect()
    if rows:
        raise QualityError(message + ": " + "; ".join(str(r.asDict()) for r in rows))


def require_unique(df: DataFrame, keys: list[str], name: str = "frame") -> DataFrame:
    """Check now."""
    require_empty(duplicate_keys(df, keys), f"duplicate keys {keys} in {name}")
    return df


def unique_keys(df: DataFrame, keys: list[str], name: str = "frame") -> DataFrame:
    """The frame itself; a key that occurs twice fails the job that reads it. Keys with a NULL match nothing and may repeat."""
    copies = F.count("*").over(Window.partitionBy(*keys))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    problem = F.raise_error(F.concat(F.lit(f"duplicate keys in {name}: "), F.to_json(F.struct(*keys)))).cast("boolean")
    checked = df.withColumn("_copies", copies)
    return checked.where(F.when(known & (F.col("_copies") > 1), problem).otherwise(F.lit(True))).drop("_copies")
