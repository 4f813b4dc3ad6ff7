"""From observations to the modelling table (AG9-AG13, WN10, JN3, JN4, GV7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lenient_year
from ..functions.text import is_marker_row
from ..operators.joins import common_keys, many_to_one, one_to_one, past_cutoff, split_at_cutoff
from ..operators.gates import validate_dataset  # noqa: F401  part of this module's interface
from ..operators.quality import require_unique
from ..operators.rolling import rolling_features
from ..schemas import ENTITY_CYCLE, SERIES_KEYS

#: One value per cycle, carried along: grouping by the series keys alone keeps the window's partitioning and order.
CYCLE_FACTS = ["election_date", "dataset_split"]


def build_rolling(
    polls: DataFrame, dates: DataFrame, order: list[str], window: int = 5, exclude_markers: str = "any",
    strict_cutoff: bool = True,
) -> DataFrame:
    """Cutoff, result-row removal, then rolling features.

    ``exclude_markers="date"`` with ``strict_cutoff=False`` looks for result rows in the date text only and keeps
    the cutoff day, which lets results posing as polls through; the defaults do not.
    """
    retained, _ = split_at_cutoff(polls, dates, strict=strict_cutoff)
    rows = retained.where(F.col("poll_date").isNotNull())
    if exclude_markers == "any":
        rows = rows.where(~is_marker_row(F.col("date_raw"), F.col("pollster")))
    elif exclude_markers == "date":
        rows = rows.where(~F.col("is_election_result"))
    return rolling_features(rows.drop("election_date"), order, window=window)


def chronological_split(cycles: DataFrame, holdout: int = 2, keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """WN10: the last cycles of each entity are held out, always leaving one for development.

    The window runs over distinct cycles, not observations.
    """
    entity, cycle = keys
    newest = Window.partitionBy(entity).orderBy(F.col(cycle).desc())
    size = F.count("*").over(Window.partitionBy(entity))
    held = F.row_number().over(newest) <= F.least(F.lit(holdout), size - 1)
    return cycles.select(*keys).distinct().withColumn(
        "dataset_split", F.when(held, "holdout").otherwise("development")
    )


def split_table(development: DataFrame, holdout: DataFrame, keys: list[str] = ENTITY_CYCLE, check: bool = True) -> DataFrame:
    """GV7: stored split lists as one table; a cycle in both is an error. Years may be stored as ``2010.0``."""
    parts = [
        df.select(keys[0], lenient_year(F.col(keys[1])).alias(keys[1]), F.lit(name).alias("dataset_split"))
        for name, df in (("development", development), ("holdout", holdout))
    ]
    splits = parts[0].unionByName(parts[1]).where(F.col(keys[1]).isNotNull())
    return require_unique(splits, keys, "splits") if check else splits


def modelled_cycles(truth: DataFrame, features: DataFrame) -> DataFrame:
    """JN8."""
    return common_keys(truth, features)


def dated_features(features: DataFrame, dates: DataFrame, splits: DataFrame) -> DataFrame:
    """JN3 + JN11: features of split cycles with known dates, flagged when past the cutoff."""
    dated = many_to_one(features, dates.select(*ENTITY_CYCLE, "election_date"), ENTITY_CYCLE)
    dated = many_to_one(dated, splits.select(*ENTITY_CYCLE, "dataset_split"), ENTITY_CYCLE)
    return dated.withColumn("is_post_election", past_cutoff(F.col("poll_date"), F.col("election_date")))


def _zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def feature_block(
    rows: DataFrame, order: list[str], keys: list[str] = SERIES_KEYS, recent_days: int = 30, on_empty: str = "error"
) -> DataFrame:
    """AG9-AG11: one row per series and cycle, a single aggregation over all its observations.

    The last observation is a ``max_by``; the recent window is a set of conditional aggregates. A series without
    recent observations fails the job (``on_empty="error"``) or gets NULL figures (``"null"``).
    """
    day, cutoff = F.col("poll_date"), F.col("election_date")
    recent = day.between(F.date_sub(cutoff, recent_days), cutoff) & F.col("pct").isNotNull()
    pct = F.when(recent, F.col("pct"))
    elapsed = F.when(recent, F.datediff(day, cutoff).cast("double"))
    last = F.struct("poll_date", "pct", "rolling_avg", "momentum_1st_diff", "momentum_2nd_diff")
    agg = rows.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in CYCLE_FACTS],
        F.max_by(last, F.struct(*order)).alias("_last"),
        F.avg(pct).alias("recent_30d_mean"),
        F.stddev_pop(pct).alias("recent_30d_std"),
        F.count(pct).alias("recent_30d_observations"),
        F.regr_slope(pct, elapsed).alias("_slope"),
        F.min(elapsed).alias("_from"),
        F.max(elapsed).alias("_to"),
        F.avg("pct").alias("mean_poll_pct"),
        F.stddev_pop("pct").alias("poll_std"),
        F.min("pct").alias("min_poll_pct"),
        F.max("pct").alias("max_poll_pct"),
        F.avg("rolling_avg").alias("mean_rolling_avg"),
        _zero_if_null(F.avg("momentum_1st_diff")).alias("mean_momentum_1st"),
        _zero_if_null(F.avg("momentum_2nd_diff")).alias("mean_momentum_2nd"),
        F.count("*").alias("n_poll_observations"),
        F.datediff(F.max(day), F.min(day)).alias("campaign_span_days"),
    )
    n = F.col("recent_30d_observations")
    if on_empty == "error":
        message = F.concat(F.lit("no observations in the recent window for "), F.concat_ws(" ", *keys[:3]))
        n = F.when(n == 0, F.raise_error(message).cast("bigint")).otherwise(n)
    flat = F.when(F.col("_from") < F.col("_to"), F.col("_slope"))
    return agg.select(
        *keys,
        *CYCLE_FACTS,
        F.col("_last.poll_date").alias("last_poll_date"),
        F.datediff("election_date", "_last.poll_date").alias("days_before_election"),
        F.col("_last.pct").alias("final_poll_pct"),
        F.col("_last.rolling_avg").alias("final_rolling_avg"),
        _zero_if_null(F.col("_last.momentum_1st_diff")).alias("final_momentum_1st"),
        _zero_if_null(F.col("_last.momentum_2nd_diff")).alias("final_momentum_2nd"),
        "recent_30d_mean",
        "recent_30d_std",
        n.alias("recent_30d_observations"),
        _zero_if_null(flat).alias("recent_30d_trend_per_day"),
        (F.col("_last.rolling_avg") - F.col("recent_30d_mean")).alias("final_vs_recent_30d_mean"),
        "mean_poll_pct", "poll_std", "min_poll_pct", "max_poll_pct", "mean_rolling_avg", "mean_momentum_1st",
        "mean_momentum_2nd", "n_poll_observations", "campaign_span_days",
    )


def winner_flags(truth: DataFrame, keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """AG12: 1 on every row that equals its cycle's maximum."""
    known = truth.where(F.col("actual_pct").isNotNull())
    top = F.max("actual_pct").over(Window.partitionBy(*keys))
    return known.withColumn("is_winner", (F.col("actual_pct") == top).cast("int"))


def training_targets(truth: DataFrame, splits: DataFrame) -> DataFrame:
    """Truth rows of the split cycles with winner flags."""
    inside = many_to_one(truth, splits.select(*ENTITY_CYCLE), ENTITY_CYCLE)
    return winner_flags(inside).select(*SERIES_KEYS, "actual_pct", "is_winner")


def model_dataset(
    features: DataFrame, truth: DataFrame, dates: DataFrame, splits: DataFrame, order: list[str],
    model_series: Column | None = None, on_empty: str = "error",
) -> DataFrame:
    """AG9 + JN4: modelling table, one row per series and cycle with its truth."""
    dated = dated_features(features, dates, splits)
    before = dated.where(~F.col("is_post_election"))
    if model_series is not None:
        before = before.withColumn("party", model_series).where(F.col("party").isNotNull())
    return one_to_one(feature_block(before, order, on_empty=on_empty), training_targets(truth, splits), SERIES_KEYS)


def model_audit(dated: DataFrame, dataset: DataFrame) -> DataFrame:
    """AG13: source rows and removed rows next to model rows, winners and poll dates."""
    source = dated.groupBy(*ENTITY_CYCLE).agg(
        F.count("*").alias("source_feature_rows"),
        F.sum(F.col("is_post_election").cast("int")).alias("post_election_rows"),
    )
    model = dataset.groupBy(*ENTITY_CYCLE, "dataset_split").agg(
        F.count("*").alias("model_party_rows"),
        F.sum("is_winner").alias("winner_rows"),
        F.min("last_poll_date").alias("earliest_model_poll"),
        F.max("last_poll_date").alias("latest_model_poll"),
    )
    return source.join(model, ENTITY_CYCLE, "left")
