"""Joins of observations with truth, cutoff dates, splits and audits (JN1-JN13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lenient_year
from ..functions.text import is_marker_row
from ..schemas import ENTITY_CYCLE, SERIES_KEYS
from .quality import unique_keys


def with_int_cycle(df: DataFrame, cycle: str = "election_year") -> DataFrame:
    """JN1: years as text or ``2010.0`` become integers; rows without a usable year are dropped."""
    return df.withColumn(cycle, lenient_year(F.col(cycle))).where(F.col(cycle).isNotNull())


def many_to_one(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", check: bool = True
) -> DataFrame:
    """JN2-JN4: join to a frame with unique keys; a key that occurs twice is an error unless ``check`` is off."""
    if check:
        right = unique_keys(right, keys)
    return left.join(right, keys, how)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """JN4."""
    if check:
        left = unique_keys(left, keys, "left side")
    return many_to_one(left, right, keys, "inner", check)


def observation_errors(polls: DataFrame, truth: DataFrame, keys: list[str] = SERIES_KEYS) -> DataFrame:
    """JN1: observations with a known truth, with signed and absolute error."""
    joined = many_to_one(with_int_cycle(polls), with_int_cycle(truth).select(*keys, "actual_pct"), keys)
    signed = F.col("pct") - F.col("actual_pct")
    return joined.withColumn("signed_error", signed).withColumn("abs_error", F.abs(signed))


def named_sources(polls: DataFrame) -> DataFrame:
    """SC5: drop rows without a source and result rows posing as observations."""
    return polls.where(F.col("pollster").isNotNull() & ~is_marker_row(F.col("date_raw"), F.col("pollster")))


def past_cutoff(date: Column, cutoff: Column, strict: bool = False) -> Column:
    """JN11: is the observation past the cutoff? ``strict`` also counts the cutoff day; unknown dates are kept."""
    hit = (date >= cutoff) if strict else (date > cutoff)
    return F.coalesce(hit, F.lit(False))


def mark_cutoff(polls: DataFrame, dates: DataFrame, keys: list[str] = ENTITY_CYCLE, strict: bool = False) -> DataFrame:
    dated = many_to_one(polls, dates.select(*keys, "election_date"), keys, "left")
    return dated.withColumn("is_post_election", past_cutoff(F.col("poll_date"), F.col("election_date"), strict))


def split_at_cutoff(
    polls: DataFrame, dates: DataFrame, keys: list[str] = ENTITY_CYCLE, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """JN11 / GV5: (retained, removed) observations."""
    marked = mark_cutoff(polls, dates, keys, strict)
    return (
        marked.where(~F.col("is_post_election")).drop("is_post_election"),
        marked.where("is_post_election").drop("is_post_election"),
    )


def common_keys(a: DataFrame, b: DataFrame, keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """JN8: keys present on both sides."""
    return a.select(*keys).where(F.col(keys[-1]).isNotNull()).intersect(b.select(*keys))


def unmatched_series(polls: DataFrame, matched: DataFrame, series: str = "party") -> DataFrame:
    """JN13: series labels that never met a truth."""
    return polls.select(series).distinct().join(matched.select(series).distinct(), series, "left_anti")


def exclusion_audit(
    observed: DataFrame, targets: DataFrame, keys: list[str] = ENTITY_CYCLE, series: str = "party",
    model_series: str = "model_party",
) -> DataFrame:
    """JN6 / GV6: distinct series left out of the model, with the reason."""
    distinct = observed.select(*keys, series, model_series).distinct()
    known = targets.select(*keys, F.col(series).alias(model_series), F.lit(True).alias("_known")).distinct()
    status = (
        F.when(F.col(model_series).isNull(), "excluded by documented modelling scope")
        .when(F.col("_known").isNull(), "no matching actual-result target")
        .otherwise("included")
    )
    audited = distinct.join(known, [*keys, model_series], "left").withColumn("status", status)
    return audited.where(F.col("status") != "included").select(*keys, series, model_series, "status")


def fold_training_sizes(df: DataFrame, keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """JN9: rows and cycles every leave-one-cycle-out fold trains on, as total minus own (no pairing of folds)."""
    own = df.groupBy(*keys).agg(F.count("*").alias("test_rows"))
    total = own.agg(F.sum("test_rows").alias("rows"), F.count("*").alias("cycles")).first()
    return own.select(
        *keys,
        "test_rows",
        (F.lit(total["rows"] or 0) - F.col("test_rows")).alias("train_rows"),
        F.lit((total["cycles"] or 0) - 1).cast("bigint").alias("train_cycles"),
    )
