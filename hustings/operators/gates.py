"""Quality figures that are counted while a frame is written, and gates on them (QC1-QC8, IO8).

All figures of a frame ride on the one job that writes it: row rules are conditional counts, rules on keys and cycles
are flags of one window pass below them. They are observed in the writing stage itself, where a task that is run again
after a lost executor replaces its first figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..schemas import ENTITY_CYCLE, SERIES_KEYS
from .quality import QualityError, after_cutoff, duplicate_keys, outside_split, require_empty, uncovered, wrong_winner_counts

FLAGS = ["_copies", "_winners", "_first", "_expected"]


def number_figures(columns: list[str]) -> dict[str, Column]:
    """QC5: missing and infinite values of each column."""
    out = {}
    for c in columns:
        v = F.col(c).cast("double")
        out[f"missing {c}"] = F.count_if(v.isNull() | F.isnan(v))
        out[f"infinite {c}"] = F.count_if(F.coalesce(F.abs(v) == float("inf"), F.lit(False)))
    return out


def gap_figure(signed: str, absolute: str) -> Column:
    """QC8: largest gap between an absolute error and the signed error's size."""
    return F.max(F.abs(F.abs(F.col(signed)) - F.col(absolute)))


def flagged(df: DataFrame, splits: DataFrame, keys: list[str] = SERIES_KEYS, cycle: list[str] = ENTITY_CYCLE) -> DataFrame:
    """The rows with what the figures on keys and cycles need; one shuffle, on the cycle. NULL keys are values as others."""
    by_cycle = Window.partitionBy(*cycle)
    expected = splits.select(*[F.col(c).alias(f"_e_{c}") for c in cycle]).distinct().withColumn("_expected", F.lit(True))
    same = F.lit(True)
    for c in cycle:
        same = same & F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    rows = df.withColumns(
        {
            "_winners": F.coalesce(F.sum("is_winner").over(by_cycle), F.lit(0)),
            "_first": F.row_number().over(by_cycle.orderBy(*[k for k in keys if k not in cycle])) == 1,
        }
    ).withColumn("_copies", F.count("*").over(Window.partitionBy(*keys)))
    joined = rows.join(expected, same, "left").drop(*[f"_e_{c}" for c in cycle])
    return joined.withColumn("_expected", F.coalesce("_expected", F.lit(False)))


def dataset_figures(numbers: list[str] = (), split: str | None = None) -> dict[str, Column]:
    """QC1-QC7 of a ``flagged`` modelling table; ``numbers`` are searched for missing values, ``split`` is the only one allowed."""
    return {
        "rows": F.count("*"),
        "cycles": F.count_if("_first"),
        "repeated keys": F.count_if(F.col("_copies") > 1),
        "cycles without one winner": F.count_if(F.col("_first") & (F.col("_winners") != 1)),
        "past the cutoff": F.count_if(F.coalesce(F.col("last_poll_date") > F.col("election_date"), F.lit(False))),
        "covered cycles": F.count_if(F.col("_first") & F.col("_expected")),
        **({} if split is None else {f"outside {split}": F.count_if(~F.col("dataset_split").eqNullSafe(split))}),
        **number_figures(list(numbers)),
    }


def write_observed(df: DataFrame, path: str, figures: dict[str, Column], kind: str = "parquet", mode: str = "errorifexists", drop: list[str] = ()) -> dict:
    """Write a frame once and return the figures counted meanwhile; ``drop``: columns only the figures need."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in figures.items()]).drop(*drop).write.mode(mode).format(kind).save(path)
    return seen.get


def store_dataset(dataset: DataFrame, splits: DataFrame, path: str, numbers: list[str] = (), split: str | None = None) -> dict:
    """Write the modelling table with all its gates in one job; a gate that fails raises, and the files are not to be used.

    Returns the figures (``dataset_figures``).
    """
    figures = write_observed(flagged(dataset, splits), path, dataset_figures(numbers, split), drop=FLAGS)
    require_gates(figures, dataset.sparkSession.read.parquet(path), splits)
    return figures


def validate_dataset(dataset: DataFrame, splits: DataFrame) -> dict:
    """QC1-QC4 as gates over a frame that is not written: one aggregation. Returns the figures."""
    figures = flagged(dataset, splits).agg(*[c.alias(n) for n, c in dataset_figures().items()]).first().asDict()
    require_gates(figures, dataset, splits)
    return figures


def require_gates(figures: dict, dataset: DataFrame, splits: DataFrame) -> None:
    """Raise for the first gate that fails; only then the offending rows are looked for."""
    if not figures["rows"]:
        raise QualityError("the modelling dataset is empty")
    if figures["repeated keys"]:
        require_empty(duplicate_keys(dataset, SERIES_KEYS), f"duplicate keys {SERIES_KEYS} in model dataset")
    if figures["past the cutoff"]:
        require_empty(after_cutoff(dataset), "observations past the cutoff remain")
    if figures["covered cycles"] < splits.select(*ENTITY_CYCLE).distinct().count():
        require_empty(uncovered(splits, dataset), "no model rows for these cycles")
    if figures["cycles without one winner"]:
        require_empty(wrong_winner_counts(dataset), "expected exactly one winner per cycle")
    for name, n in figures.items():
        if name.startswith("outside ") and n:
            require_empty(outside_split(dataset, name.removeprefix("outside ")), f"rows {name}")
