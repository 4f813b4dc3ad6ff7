"""Observation-ordered rolling mean and finite differences (WN1-WN3).

A series can be far larger than one task should sort, so series are cut into contiguous chunks of about
``rows_per_task`` rows; each chunk borrows the few rows before it, and every row sees exactly the rows it would see in
the undivided series. NULL keys, dates and ties are values like others (NULL sorts first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SERIES_KEYS
from ..sizing import null_safe_join

CHUNK = ["_block", "_part"]
#: Rows of a chunk, about as many as one task sorts well.
ROWS_PER_TASK = 4_000_000


def rolling_features(
    df: DataFrame,
    order: list[str],
    keys: list[str] = SERIES_KEYS,
    value: str = "pct",
    window: int = 5,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``rolling_avg`` (last ``window`` observations, partial at the start) and both differences of ``value``.

    ``order`` must be a total order: the date first, then tie-breaking columns (the first of them numeric, so that a
    single crowded date can be split as well). With ``rows_per_task=None``, for callers who know their series to be
    short, a series is one window.
    """
    if rows_per_task is None:
        return _rolling(df, keys, order, value, window)
    chunked = with_chunks(df, keys, order, rows_per_task)
    # Only series of several chunks lend rows: where there are none, this branch shuffles and sorts nothing.
    borrowed = _rows_before_chunk(chunked.where("_many").drop("_many"), keys, order, value, max(window - 1, 2))
    both = chunked.drop("_many").withColumn("_borrowed", F.lit(False)).unionByName(
        borrowed.withColumn("_borrowed", F.lit(True)), allowMissingColumns=True
    )
    rolled = _rolling(both, keys + CHUNK, order, value, window)
    return rolled.where(~F.col("_borrowed")).drop("_borrowed", *CHUNK)


def _rolling(df: DataFrame, partition: list[str], order: list[str], value: str, window: int) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    v = F.col(value)
    one_back, two_back = F.lag(v, 1).over(w), F.lag(v, 2).over(w)
    return df.withColumns(
        {
            "rolling_avg": F.avg(v).over(w.rowsBetween(-(window - 1), 0)),
            "momentum_1st_diff": v - one_back,
            "momentum_2nd_diff": (v - one_back) - (one_back - two_back),
        }
    )


def with_chunks(df: DataFrame, keys: list[str], order: list[str], rows_per_task: int) -> DataFrame:
    """Label rows with chunk columns that never decrease along ``order`` within a series; ``_many``: it has more than one chunk.

    Days are counted (map-side combined) and packed into blocks; a day larger than a block is divided by equal
    ranges of the time within the day, where ``order`` starts with a timestamp, or of the first tie-breaking column. All
    figures are exact, so recomputation gives the same chunks.
    """
    date, *ties = order
    timed = isinstance(df.schema[date].dataType, (T.TimestampType, T.TimestampNTZType))
    if timed:
        split_by = F.unix_micros(F.col(date).cast("timestamp")).cast("double")
    else:
        split_by = F.col(ties[0]).cast("double") if ties and isinstance(df.schema[ties[0]].dataType, T.NumericType) else None
    df = df.withColumn("_day", F.to_date(date) if timed else F.col(date))
    ends = [F.min(split_by).alias("_lo"), F.max(split_by).alias("_hi")] if split_by is not None else []
    days = df.groupBy(*keys, "_day").agg(F.count("*").alias("_n"), *ends)
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns(
        {
            "_block": F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / rows_per_task),
            "_parts": F.ceil(F.col("_n") / rows_per_task),
        }
    ).drop("_n")
    series = Window.partitionBy(*keys)
    days = days.withColumn("_many", (F.max("_block").over(series) > 0) | (F.max("_parts").over(series) > 1))
    out = null_safe_join(df, days, [*keys, "_day"])
    if split_by is not None:
        share = (split_by - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        divided = F.least(F.col("_parts") - 1, F.floor(share * F.col("_parts")))
        cut = F.when(split_by.isNull(), F.lit(0)).otherwise(divided)
        part = F.when((F.col("_parts") > 1) & (F.col("_hi") > F.col("_lo")), cut)
    else:
        part = F.lit(None).cast("bigint")
    return out.withColumn("_part", F.coalesce(part, F.lit(0))).drop("_parts", "_lo", "_hi", "_day")


def _rows_before_chunk(chunked: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """The last ``n`` rows of the series before each chunk, labelled with that chunk.

    Only the last ``n`` rows of a chunk can be borrowed; ``row_number() <= n`` is pruned before the shuffle.
    """
    columns = list(dict.fromkeys([*order, value]))
    newest = Window.partitionBy(*keys, *CHUNK).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        chunked.select(*keys, *CHUNK, *[c for c in columns if c not in keys])
        .withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= n)
        .groupBy(*keys, *CHUNK)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("_pos"), *columns))).alias("_tail"))
    )
    chunks_before = Window.partitionBy(*keys).orderBy(*CHUNK).rowsBetween(-n, -1)
    earlier = F.flatten(F.collect_list("_tail").over(chunks_before))
    return (
        tails.withColumn("_earlier", earlier)
        .withColumn("_row", F.explode(F.slice("_earlier", F.greatest(F.size("_earlier") - n + 1, F.lit(1)), F.lit(n))))
        .select(*keys, *CHUNK, *[F.col(f"_row.{c}").alias(c) for c in columns if c not in keys])
    )


def last_observation(df: DataFrame, order: list[str], columns: list[str], keys: list[str] = SERIES_KEYS) -> DataFrame:
    """WN4: the given columns of each group's last row; one partial aggregate, no sort."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")
