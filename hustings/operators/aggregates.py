"""Group aggregates (AG7-AG35). All combine map-side, so a hot group costs no single task more than its partials."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ENTITY_CYCLE
from ..sizing import bounded_values
from .quantiles import grouped_quantiles


def joined_labels(column: str, sep: str = "|"):
    """Sorted distinct labels as one text."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def source_errors(errors: DataFrame, by: list[str], min_rows: int = 5) -> DataFrame:
    """AG14: mean absolute error per source, for sources with enough scored rows."""
    grouped = errors.groupBy(*by).agg(F.avg("abs_error").alias("mean_abs_error"), F.count("abs_error").alias("n_polls"))
    return grouped.where(F.col("n_polls") >= min_rows)


def house_effects(errors: DataFrame, by: list[str], min_rows: int = 10) -> DataFrame:
    """AG15: mean signed error per source and series."""
    grouped = errors.groupBy(*by).agg(F.avg("signed_error").alias("house_effect"), F.count("signed_error").alias("n_polls"))
    return grouped.where(F.col("n_polls") >= min_rows)


def volatility(polls: DataFrame, keys: list[str], entity: str = "country", value: str = "pct") -> DataFrame:
    """AG16: sample deviation per cycle and series, summarised per entity, two decimals, half to even."""
    spread = polls.groupBy(*keys).agg(F.stddev_samp(value).alias("spread")).where(F.col("spread").isNotNull())
    moments = spread.groupBy(entity).agg(
        F.avg("spread").alias("mean"), F.stddev_samp("spread").alias("std"), F.count("*").alias("count")
    )
    middle = grouped_quantiles(spread, [entity], "spread", {"median": 0.5})
    out = moments.join(middle, entity)
    return out.select(
        entity, *[F.bround(c, 2).alias(c) for c in ("mean", "median", "std")], F.col("count")
    )


def error_shape(errors: DataFrame, column: str = "signed_error") -> DataFrame:
    """AG17: size, mean, sample deviation, population skewness and excess kurtosis."""
    return errors.agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean_error"),
        F.stddev_samp(column).alias("std_error"),
        F.skewness(column).alias("skewness"),
        F.kurtosis(column).alias("kurtosis"),
    )


def series_correlation(
    polls: DataFrame, on: list[str], series: str = "party", value: str = "pct", labels: list[str] | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """AG18: correlation of every pair of series over the dates where both were observed, per group of ``by``.

    The pivot puts one date on one row, so pairs are columns of a single aggregate and no rows are paired.
    """
    labels = labels or bounded_values(polls, series, 200)
    by = by or []
    means = polls.groupBy(*by, *on).pivot(series, labels).agg(F.avg(value))
    pairs = list(combinations(range(len(labels)), 2))
    cell = [F.col(f"`{name}`") for name in labels]
    wide = means.groupBy(*by).agg(
        *[F.corr(cell[i], cell[j]).alias(f"c{i}_{j}") for i, j in pairs],
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cell)],
    )
    rows = []
    for i, j in pairs:
        rows += [(i, j, f"c{i}_{j}"), (j, i, f"c{i}_{j}")]
    entries = [
        F.struct(F.lit(labels[i]).alias("series_a"), F.lit(labels[j]).alias("series_b"), F.col(c).alias("correlation"))
        for i, j, c in rows
    ]
    entries += [
        F.struct(
            F.lit(name).alias("series_a"),
            F.lit(name).alias("series_b"),
            F.when(F.col(f"n{i}") > 1, 1.0).alias("correlation"),
        )
        for i, name in enumerate(labels)
    ]
    return wide.select(*by, F.explode(F.array(*entries)).alias("r")).select(*by, "r.*")


def error_summary(df: DataFrame, by: list[str], absolute: str = "absolute_error") -> DataFrame:
    """AG21: rows, mean, exact median and maximum of the absolute error."""
    base = df.groupBy(*by).agg(
        F.count("*").alias("evaluated_party_rows"),
        F.avg(absolute).alias("mean_absolute_error"),
        F.max(absolute).alias("maximum_absolute_error"),
    )
    return base.join(grouped_quantiles(df, by, absolute, {"median_absolute_error": 0.5}), by)


def signed_error_summary(df: DataFrame, by: list[str], signed: str, absolute: str, cycle: str = "election_year") -> DataFrame:
    """AG20: rows, cycles, MAE, mean error and RMSE."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_distinct(cycle).alias("elections"),
        F.avg(absolute).alias("mae"),
        F.avg(signed).alias("mean_error"),
        F.sqrt(F.avg(F.col(signed) * F.col(signed))).alias("rmse"),
    )


def two_model_error_summary(df: DataFrame, by: list[str], cycle: str = "election_year") -> DataFrame:
    """AG19: MAE and mean error of the benchmark and of the challenger side by side."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_distinct(cycle).alias("elections"),
        F.avg("baseline_abs_error").alias("baseline_mae"),
        F.avg("baseline_error").alias("baseline_mean_error"),
        F.avg("ridge_abs_error").alias("ridge_mae"),
        F.avg("ridge_error").alias("ridge_mean_error"),
    )


def volume_summary(df: DataFrame, by: list[str], volume: str = "n_poll_observations") -> DataFrame:
    """AG22."""
    return df.groupBy(*by).agg(F.sum(volume).alias("poll_observations"), F.count("*").alias("campaign_party_rows"))


def winner_record(cycles: DataFrame, by: list[str], correct: str = "winner_correct") -> DataFrame:
    """AG23."""
    return cycles.groupBy(*by).agg(
        F.count("*").alias("elections"),
        F.sum(correct).alias("correct_winners"),
        (F.count("*") - F.sum(correct)).alias("wrong_winners"),
        (F.sum(correct) / F.count("*")).alias("winner_accuracy"),
    )


def split_summary(cycles: DataFrame, by: list[str]) -> DataFrame:
    """AG24."""
    return cycles.groupBy(*by).agg(
        F.count("*").alias("elections"),
        F.avg("election_mae").alias("mean_election_mae"),
        F.sum("winner_correct").alias("correct_winners"),
    )


def scope_kpis(audit: DataFrame) -> DataFrame:
    """AG25: lots, entities, cycles, rows and lots by decision."""
    return audit.agg(
        F.count("*").alias("source_tables"),
        F.count_distinct("country").alias("countries"),
        F.count_distinct("country", "election_year").alias("elections"),
        F.sum("poll_party_rows").alias("poll_party_rows"),
        F.count_if(F.col("scope_status") == "approved_marker_match").alias("approved"),
        F.count_if(F.col("scope_status") == "rejected_marker_mismatch").alias("rejected"),
        F.count_if(F.col("scope_status") == "review").alias("review"),
    )


def composition(audit: DataFrame, by: list[str]) -> DataFrame:
    """AG26: lots and rows per group, with each group's share of all rows."""
    grouped = audit.groupBy(*by).agg(
        F.count("source_table").alias("source_tables"), F.sum("poll_party_rows").alias("poll_party_rows")
    )
    whole = F.sum("poll_party_rows").over(Window.partitionBy(F.lit(1)))
    return grouped.withColumn("row_share_pct", 100.0 * F.col("poll_party_rows") / whole)


def hierarchy_totals(audit: DataFrame, levels: list[str], value: str = "poll_party_rows") -> DataFrame:
    """AG27: subtotals along a path of levels; ``level`` is 0 for single rows and grows towards the root."""
    return audit.rollup(*levels).agg(
        F.sum(value).alias(value), F.count("*").alias("source_tables"), F.grouping_id().cast("int").alias("level")
    )


def reason_totals(audit: DataFrame, reason: str = "scope_reason") -> DataFrame:
    """AG28."""
    named = F.coalesce(F.when(F.col(reason) != "", F.col(reason)), F.lit("Other reviewed table"))
    return audit.groupBy(named.alias("reason")).agg(
        F.count("*").alias("source_tables"), F.sum("poll_party_rows").alias("poll_party_rows")
    )


def totals(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """AG29."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def slice_kpis(errors: DataFrame, keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """AG30."""
    return errors.agg(
        F.count("*").alias("rows"),
        F.count_distinct(*[F.col(k) for k in keys]).alias("elections"),
        F.avg("absolute_error").alias("mae"),
        F.avg("signed_error").alias("mean_signed_error"),
        F.max("absolute_error").alias("max_absolute_error"),
    )


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG32: count, mean, deviation, minimum, quartiles and maximum, one row per column."""
    long = df.unpivot([], columns, "column_name", "value").where(F.col("value").isNotNull())
    moments = long.groupBy("column_name").agg(
        F.count("*").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = grouped_quantiles(long, ["column_name"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quartiles, "column_name")


def frequency(df: DataFrame, column: str) -> DataFrame:
    """AG33, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def column_max(df: DataFrame, column: str) -> DataFrame:
    """AG34."""
    return df.agg(F.max(column).alias("max_value"))


def coverage(df: DataFrame, entity: str = "country", cycle: str = "election_year") -> DataFrame:
    """AG35: distinct cycles per entity."""
    return df.groupBy(entity).agg(F.count_distinct(cycle).alias("elections"))
