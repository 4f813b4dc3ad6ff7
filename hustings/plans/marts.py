"""Reporting tables (PR1-PR8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_date
from ..functions.scalars import attach_metadata, bubble_size, cycle_label, result_annotation, status_text
from ..operators.aggregates import error_summary, volume_summary, winner_record
from ..operators.joins import many_to_one
from ..operators.ordering import best_row
from ..operators.reshape import tagged_union
from ..schemas import ENTITY_CYCLE, SERIES_KEYS


def election_performance(development: DataFrame, holdout: DataFrame, holdout_errors: DataFrame, metadata: DataFrame) -> DataFrame:
    """PR1: one row per cycle of either split.

    ``development``: ML14 rows; ``holdout``: ML12 results; ``holdout_errors``: ML12 prediction rows.
    """
    common = ["country", "election_year", "winner_correct", "actual_winner", "predicted_winner", "election_mae"]
    mae = holdout_errors.groupBy(*ENTITY_CYCLE).agg(F.avg("absolute_error").alias("election_mae"))
    both = tagged_union(
        {
            "Development": (
                development,
                {"polling_winner": "predicted_winner", "election_baseline_mae": "election_mae"},
            ),
            "Holdout": (holdout.join(mae, ENTITY_CYCLE), {}),
        },
        common,
        "split",
    )
    return attach_metadata(both, metadata).select(
        "country", "country_label", "iso_alpha", "election_year", "split", "election_mae", "winner_correct",
        status_text(F.col("winner_correct")).alias("result_status"), "actual_winner", "predicted_winner",
        result_annotation(F.col("election_mae"), F.col("winner_correct")).alias("annotation"),
    )


def country_performance(elections: DataFrame, party_errors: DataFrame, dataset: DataFrame) -> DataFrame:
    """PR2 / JN10: error, volume, winner record and worst cycle per entity (17 columns)."""
    worst = best_row(
        elections, ["country"], [F.col("election_mae").desc(), F.col("election_year")],
        ["country_label", "iso_alpha", "election_year", "election_mae", "result_status"],
    ).select(
        "country", "country_label", "iso_alpha",
        cycle_label(F.col("country_label"), F.col("election_year")).alias("worst_election"),
        F.col("election_mae").alias("worst_election_mae"),
        F.col("result_status").alias("worst_election_result_status"),
    )
    out = error_summary(party_errors, ["country"])
    for part in (volume_summary(dataset, ["country"]), winner_record(elections, ["country"]), worst):
        out = out.join(part, "country")
    return out.select(
        "country", "country_label", "iso_alpha", "poll_observations", "campaign_party_rows", "evaluated_party_rows",
        "elections", "correct_winners", "wrong_winners", "winner_accuracy",
        (F.col("winner_accuracy") * 100.0).alias("winner_accuracy_pct"), "mean_absolute_error",
        "median_absolute_error", "maximum_absolute_error", "worst_election", "worst_election_mae",
        "worst_election_result_status",
    )


def trajectories(rolling: DataFrame, splits: DataFrame, dataset: DataFrame, metadata: DataFrame) -> DataFrame:
    """PR3: every rolling row with its split, truth and inclusion flag; a cycle without a split fails the job."""
    split = many_to_one(rolling, splits.select(*ENTITY_CYCLE, "dataset_split"), ENTITY_CYCLE, "left")
    targets = dataset.select(*SERIES_KEYS, "actual_pct", "is_winner", "n_poll_observations", "poll_std")
    full = attach_metadata(many_to_one(split, targets, SERIES_KEYS, "left"), metadata.select("country", "country_label"))
    missing = F.raise_error(F.concat(F.lit("no split for "), cycle_label(F.col("country"), F.col("election_year"))))
    return full.select(
        "country", "country_label", "election_year",
        cycle_label(F.col("country_label"), F.col("election_year")).alias("election_label"),
        F.coalesce("dataset_split", missing).alias("dataset_split"),
        "party", iso_date(F.col("poll_date")).alias("poll_date"), "pct", "rolling_avg", "momentum_1st_diff",
        "momentum_2nd_diff", F.col("actual_pct").isNotNull().alias("model_included"), "actual_pct",
        F.coalesce("is_winner", F.lit(0)).alias("is_winner"), "n_poll_observations", "poll_std",
    )


def party_errors(development: DataFrame, holdout: DataFrame, dataset: DataFrame, metadata: DataFrame) -> DataFrame:
    """PR4 / ST2: errors of both splits with features, roles and bubble sizes."""
    common = [*SERIES_KEYS, "actual_pct", "predicted_pct", "signed_error", "absolute_error"]
    both = tagged_union(
        {
            "Development": (
                development,
                {"baseline_vote_prediction": "predicted_pct", "baseline_error": "signed_error", "baseline_abs_error": "absolute_error"},
            ),
            "Holdout": (holdout, {"selected_vote_prediction": "predicted_pct", "vote_share_error": "signed_error"}),
        },
        common,
        "evaluation_split",
    )
    features = dataset.select(
        *SERIES_KEYS, "dataset_split", "is_winner", "n_poll_observations", "poll_std", "campaign_span_days",
        "recent_30d_observations",
    )
    full = attach_metadata(both.join(features, SERIES_KEYS), metadata.select("country", "country_label"))
    role = status_text(F.col("is_winner"), "Election winner", "Other modelled party")
    return full.select(
        "country", "country_label", "election_year",
        cycle_label(F.col("country_label"), F.col("election_year")).alias("election_label"),
        "party", role.alias("party_role"), "evaluation_split", "dataset_split", "actual_pct", "predicted_pct",
        "signed_error", "absolute_error", "n_poll_observations", "poll_std",
        bubble_size(F.col("poll_std")).alias("bubble_size"), "campaign_span_days", "recent_30d_observations",
    )


def optional_filters(df: DataFrame, every: str = "All", **choices) -> DataFrame:
    """PR8: keep rows matching each choice; ``"All"`` or None leaves a column free, a list means membership."""
    for column, choice in choices.items():
        if choice is None or choice == every:
            continue
        df = df.where(F.col(column).isin(choice) if isinstance(choice, (list, tuple, set)) else F.col(column) == choice)
    return df


def trajectory_slice(trajectory: DataFrame, country: str, year: int, parties: list[str] | None = None) -> DataFrame:
    """PR5: rows of one cycle and the chosen series."""
    return optional_filters(trajectory, country=country, election_year=year, party=parties)


def trajectory_kpis(part: DataFrame) -> DataFrame:
    """PR5: observations, series, first and last date."""
    return part.agg(
        F.count("*").alias("observations"),
        F.count_distinct("party").alias("parties"),
        F.min("poll_date").alias("first_poll"),
        F.max("poll_date").alias("last_poll"),
    )


def trailing_range(df: DataFrame, months: int | None, by: list[str], date: str = "poll_date") -> DataFrame:
    """PR6: rows of the last months before each group's latest date; None keeps everything."""
    if months is None:
        return df
    ends = df.groupBy(*by).agg(F.add_months(F.max(date), -months).alias("_from"))
    return df.join(ends, by).where(F.col(date) >= F.col("_from")).drop("_from")


def case_study(results: DataFrame, predictions: DataFrame, country: str, year: int) -> DataFrame:
    """PR7: one cycle, its series with true and polled figures next to the cycle's outcome."""
    cycle = optional_filters(results, country=country, election_year=year)
    series = optional_filters(predictions, country=country, election_year=year)
    place = F.row_number().over(Window.partitionBy(*ENTITY_CYCLE).orderBy(F.col("actual_pct").desc(), "party"))
    chosen = series.select(*SERIES_KEYS, "actual_pct", "selected_vote_prediction", "vote_share_error", "absolute_error")
    outcome = cycle.select(*ENTITY_CYCLE, "actual_winner", "predicted_winner", "winner_correct", "predicted_margin", "actual_margin")
    return chosen.withColumn("place", place).join(outcome, ENTITY_CYCLE)
