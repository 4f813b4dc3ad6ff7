"""Exact quantiles, histograms and box summaries (AG21, AG31)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sizing import null_safe_join
from .ordering import ordered_ranges


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles per group, one column per entry of ``probs``.

    ``percentile`` keeps every distinct value of a group in memory, so it is not used. Values are counted before any
    shuffle and dealt to ranges in order of group and value, so a large group fills many ranges and no task sees all of it.
    The counts of the ranges tell which of them hold a wanted rank; only these are searched.
    """
    if not keys:
        whole = df.withColumn("_all", F.lit(1))
        return grouped_quantiles(whole, ["_all"], value, probs).drop("_all")
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    ranged = ordered_ranges(counted, [*map(F.col, keys), F.col("_v")])
    # A row per group and range: a group has at most as many as there are ranges.
    parts = ranged.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_held"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({
        "_before": F.coalesce(F.sum("_held").over(earlier), F.lit(0)), "_n": F.sum("_held").over(group),
    })
    pos = {name: F.lit(p) * (F.col("_n") - 1) for name, p in probs.items()}
    wanted = F.lit(False)
    for at in pos.values():
        for rank in (F.floor(at), F.ceil(at)):
            wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_held")))
    inside = null_safe_join(ranged, parts.where(wanted), [*keys, "_bucket"])
    upto = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(upto))
    picks = []
    for name, at in pos.items():
        picks.append(F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v"))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v"))).alias(f"_hi_{name}"))
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, at in pos.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *out)


def box_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AG31: five-number summary per group."""
    return grouped_quantiles(
        df, keys, value, {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    )


def histogram(df: DataFrame, value: str, bins: int = 24, by: list[str] | None = None) -> DataFrame:
    """AG31: equal-width bins over the whole range; the last bin includes the maximum."""
    rows = df.where(F.col(value).isNotNull())
    span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if span.lo is None:
        return rows.select(*(by or []), F.lit(0).alias("bin")).groupBy(*(by or []), "bin").agg(F.count("*").alias("n"))
    width = (span.hi - span.lo) / bins or 1.0
    index = F.least(F.floor((F.col(value) - F.lit(span.lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*(by or []), index.alias("bin")).agg(F.count("*").alias("n"))
