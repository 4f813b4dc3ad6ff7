"""Scalar building blocks (SC2-SC20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import plain_number


# Metrics bounded by one that are shown as percentages.
BOUNDED_METRICS = ["election_winner_accuracy", "OOF_ROC_AUC", "row_accuracy_at_0.5"]


def lenient_number(col: Column) -> Column:
    """SC2: unreadable text and NaN become NULL; infinities of numeric columns stay."""
    value = F.coalesce(plain_number(col.cast("string")), F.when(col.cast("string").isin("Infinity", "-Infinity"), col.try_cast("double")))
    return F.when(~F.isnan(value), value)


def lenient_year(col: Column) -> Column:
    """Years may arrive as ``2010`` or ``2010.0``."""
    return plain_number(col.cast("string")).try_cast("int")


def lookup_text(col: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """SC12: dictionary label with a fallback (the value itself unless given)."""
    expr = reduce(lambda e, kv: e.when(col == kv[0], kv[1]), mapping.items(), F.when(F.lit(False), ""))
    return expr.otherwise(col if default is None else default)


def series_alias(entity: Column, series: Column, aliases: dict[tuple[str, str], str]) -> Column:
    """SC3: per-entity alias of a series label, e.g. {("uk", "LD"): "LIB"}."""
    expr = F.when(F.lit(False), "")
    for (e, s), target in aliases.items():
        expr = expr.when((entity == e) & (series == s), target)
    return expr.otherwise(series)


def modelled_series(
    entity: Column, series: Column, aliases: dict[tuple[str, str], str], allow: dict[str, list[str]]
) -> Column:
    """SC4: alias, then NULL for series outside an entity's allow-list."""
    named = series_alias(entity, series, aliases)
    outside = F.lit(False)
    for e, kept in allow.items():
        outside = outside | ((entity == e) & ~series.isin(kept))
    return F.when(~outside, named)


def with_errors(df: DataFrame, predicted: str, actual: str, signed: str, absolute: str) -> DataFrame:
    """SC10."""
    return df.withColumn(signed, F.col(predicted) - F.col(actual)).withColumn(absolute, F.abs(F.col(signed)))


def direction_label(signed_error: Column) -> Column:
    """SC11: exactly zero counts as an underestimate."""
    return F.when(signed_error > 0, "Overestimated").otherwise("Underestimated")


def title_label(col: Column) -> Column:
    """SC12."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def attach_metadata(df: DataFrame, metadata: DataFrame, key: str = "country") -> DataFrame:
    """SC13: join entity labels; an entity without metadata fails the job instead of vanishing."""
    known = metadata.withColumn("_known", F.lit(True))
    problem = F.raise_error(F.concat(F.lit(f"missing metadata for {key}: "), F.col(key)))
    return (
        df.join(known, key, "left")
        .withColumn(key, F.when(F.col("_known") | F.col(key).isNull(), F.col(key)).otherwise(problem))
        .drop("_known")
    )


def unknown_entities(df: DataFrame, metadata: DataFrame, key: str = "country") -> DataFrame:
    """SC13 / ST4: keys that metadata does not cover."""
    seen = df.select(key).where(F.col(key).isNotNull()).distinct()
    return seen.join(metadata.select(key), key, "left_anti")


def cycle_label(entity_label: Column, cycle: Column) -> Column:
    """SC14."""
    return F.concat_ws(" ", entity_label, cycle.cast("string"))


def result_annotation(error: Column, correct: Column) -> Column:
    """SC14: ``1.12 OK`` or ``3.40 MISS``."""
    return F.concat(F.format_string("%.2f", error), F.when(correct == 1, " OK").otherwise(" MISS"))


def winner_record_text(correct: Column, total: Column) -> Column:
    """SC14: ``13/14 correct``."""
    return F.concat(correct.cast("string"), F.lit("/"), total.cast("string"), F.lit(" correct"))


def bubble_size(spread: Column, offset: float = 0.25) -> Column:
    """SC15."""
    return F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(0.0)) + offset


def status_text(flag: Column, yes: str = "Correct winner", no: str = "Winner miss") -> Column:
    """SC18."""
    return F.when(flag == 1, yes).when(flag == 0, no)


def display_value(metric: Column, value: Column) -> Column:
    """SC19: only metrics bounded by one are scaled to percent."""
    return F.when(metric.isin(BOUNDED_METRICS), value * 100.0).otherwise(value)


def metric_lookup(metrics: DataFrame, name: str) -> DataFrame:
    """SC20: one row with the named metric's value, case-insensitive; absent is an error at run time."""
    hit = metrics.where(F.upper("metric") == name.upper()).agg(F.first("value", ignorenulls=True).alias("value"))
    return hit.select(F.coalesce("value", F.raise_error(F.lit(f"metric not found: {name}"))).alias("value"))
