"""Spark frames shared by the registered queries, mirroring the SQL fragments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import scope as S
from ..operators.joins import observation_errors
from ..plans import dataset as D
from ..plans import marts as P
from ..sizing import settled
from ..sources import adapter as A


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return A.actuals(A.polls(spark, sf))


def dates(spark: SparkSession, sf: str) -> DataFrame:
    return A.election_dates(A.polls(spark, sf))


def splits(spark: SparkSession, sf: str) -> DataFrame:
    return D.chronological_split(dates(spark, sf))


def rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Every observation up to the cutoff day; the adapter's plain polls hold no result rows."""
    polls = A.polls(spark, sf)
    return _rolling(polls, A.election_dates(polls))


def _rolling(polls: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return D.build_rolling(polls, cutoffs, A.ORDER, exclude_markers="none", strict_cutoff=False)


@dataclass(frozen=True)
class Campaign:
    """Frames that the modelling table is made of; the rolling rows are stored, the others have a row per cycle or series."""

    rolling: DataFrame
    truth: DataFrame
    cutoffs: DataFrame
    splits: DataFrame


def campaign(spark: SparkSession, sf: str) -> Campaign:
    """Polls are read once into the shared folder, then rolled once; all that follows reads the rolled rows."""
    polls = settled(A.polls(spark, sf).drop("date_raw", "source_table", "pollster"))
    cutoffs, truth_ = settled(A.election_dates(polls)), settled(A.actuals(polls))
    return Campaign(settled(_rolling(polls, cutoffs)), truth_, cutoffs, D.chronological_split(cutoffs))


def campaign_dataset(c: Campaign) -> DataFrame:
    return D.model_dataset(c.rolling, c.truth, c.cutoffs, c.splits, A.ORDER, on_empty="null")


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    polls = A.polls(spark, sf)
    cutoffs = A.election_dates(polls)
    return D.model_dataset(
        _rolling(polls, cutoffs), A.actuals(polls), cutoffs, D.chronological_split(cutoffs), A.ORDER, on_empty="null"
    )


def settled_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """One row per series and cycle, computed once for the several readers of the reporting queries."""
    return settled(dataset(spark, sf))


def out_of_fold_columns(df: DataFrame) -> DataFrame:
    """Benchmark and a mean-reading challenger in the columns the error analysis expects."""
    base, other = F.col("final_rolling_avg"), F.col("mean_poll_pct")
    return df.withColumns(
        {
            "baseline_vote_prediction": base,
            "baseline_error": base - F.col("actual_pct"),
            "baseline_abs_error": F.abs(base - F.col("actual_pct")),
            "ridge_vote_prediction": other,
            "ridge_error": other - F.col("actual_pct"),
            "ridge_abs_error": F.abs(other - F.col("actual_pct")),
        }
    )


def errors(spark: SparkSession, sf: str) -> DataFrame:
    polls = A.polls(spark, sf)
    return observation_errors(polls, A.actuals(polls))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    polls = A.polls(spark, sf)
    return S.marker_candidates(S.comparable_polls(A.with_markers(polls), {}), A.actuals(polls))


def audit(spark: SparkSession, sf: str) -> DataFrame:
    polls = A.polls(spark, sf)
    marked = S.comparable_polls(A.with_markers(polls), {})
    return S.scope_audit(marked, settled(S.marker_candidates(marked, A.actuals(polls))))


def decided(spark: SparkSession, sf: str) -> DataFrame:
    """Effective decisions with lot_19 missing from the audit, so that the fail-closed default shows."""
    marked = A.marked_polls(spark, sf)
    known = audit(spark, sf).where(F.col("source_table") != "lot_19")
    return S.effective_scope(marked, known, A.overrides(marked))


def metadata(spark: SparkSession) -> DataFrame:
    rows = [
        ("africa", "Africa", "AFR"), ("america", "America", "AME"), ("asia", "Asia", "ASI"),
        ("europe", "Europe", "EUR"), ("middle east", "Middle East", "MEA"),
    ]
    return spark.createDataFrame(rows, "country string, country_label string, iso_alpha string")


def development(df: DataFrame) -> DataFrame:
    return out_of_fold_columns(df.where(F.col("dataset_split") == "development"))


def holdout(df: DataFrame) -> DataFrame:
    return M.holdout_predictions(df.where(F.col("dataset_split") == "holdout"))


def performance(spark: SparkSession, df: DataFrame) -> DataFrame:
    held = holdout(df)
    return P.election_performance(
        M.election_error_summary(development(df)), M.election_results(held, "selected_vote_prediction"), held,
        metadata(spark),
    )
