"""True outcomes from vote counts (AG1-AG4) and candidate averages (CL25-CL27)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lenient_number
from .quality import QualityError

# Nominees and their party; order decides last-name matches.
NOMINEES = {
    "Richard Nixon": "REP", "Hubert Humphrey": "DEM", "George McGovern": "DEM", "Jimmy Carter": "DEM",
    "Gerald Ford": "REP", "Ronald Reagan": "REP", "Walter Mondale": "DEM", "George Bush": "REP",
    "Michael Dukakis": "DEM", "Bill Clinton": "DEM", "George H.W. Bush": "REP", "Bob Dole": "REP", "Al Gore": "DEM",
    "George W. Bush": "REP", "John Kerry": "DEM", "Barack Obama": "DEM", "John McCain": "REP", "Mitt Romney": "REP",
    "Hillary Clinton": "DEM", "Hillary Rodham Clinton": "DEM", "Donald Trump": "REP",
}
# Vote columns of district files and the series they count.
DISTRICT_SERIES = {
    "Bloc": "BQ", "Con": "CPC", "ConParty": "CPC", "Grn": "GPC", "Lib": "LPC", "NDP": "NDP", "Other": "OTHER",
}


def weighted_share(df: DataFrame, cycle: str, parts: dict[str, str], total: str, entity: Column) -> DataFrame:
    """AG1: sum of a series' votes over the sum of all votes; cycles without votes are skipped.

    A series whose votes are all unreadable has a share of zero.
    """
    present = {series: c for series, c in parts.items() if c in df.columns}
    sums = df.groupBy(cycle).agg(
        F.sum(lenient_number(F.col(total))).alias("_total"),
        *[F.sum(lenient_number(F.col(c))).alias(series) for series, c in present.items()],
    )
    long = sums.where(F.col("_total") != 0).unpivot([cycle, "_total"], list(present), "party", "_votes")
    return long.select(
        entity.alias("country"), F.col(cycle).cast("int").alias("election_year"), "party",
        (F.coalesce("_votes", F.lit(0.0)) / F.col("_total") * 100).alias("actual_pct"),
    )


def present_column_shares(files: list[tuple[DataFrame, int]], entity: Column, column_map: dict[str, str] = DISTRICT_SERIES) -> DataFrame:
    """AG2 over several files, each with the columns it has and the cycle that its name gives."""
    shares = [present_column_share(df.withColumn("_cycle", F.lit(cycle)), "_cycle", entity, column_map) for df, cycle in files]
    return reduce(DataFrame.unionByName, shares)


def present_column_share(
    df: DataFrame, cycle: str, entity: Column, column_map: dict[str, str] = DISTRICT_SERIES
) -> DataFrame:
    """AG2: share of each vote column among the mapped columns a file has.

    Two present columns that mean the same series are an error: it would count one series twice.
    """
    present = [c for c in column_map if c in df.columns]
    names = [column_map[c] for c in present]
    if len(names) != len(set(names)):
        raise QualityError(f"several columns map to one series: {present}")
    sums = df.groupBy(cycle).agg(*[F.sum(lenient_number(F.col(c))).alias(column_map[c]) for c in present])
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0.0)))
    long = sums.withColumn("_total", total).where(F.col("_total") != 0).unpivot([cycle, "_total"], names, "party", "_votes")
    return long.select(
        entity.alias("country"), F.col(cycle).cast("int").alias("election_year"), "party",
        (F.coalesce("_votes", F.lit(0.0)) / F.col("_total") * 100).alias("actual_pct"),
    )


def ready_shares(df: DataFrame, cycle: str, columns: dict[str, str], entity: Column) -> DataFrame:
    """AG3: published shares, one row per series (``columns``: series -> share column)."""
    wide = df.select(cycle, *[lenient_number(F.col(c)).alias(series) for series, c in columns.items()])
    long = wide.unpivot([cycle], list(columns), "party", "actual_pct")
    return long.select(entity.alias("country"), F.col(cycle).cast("int").alias("election_year"), "party", "actual_pct")


def share_by_label(df: DataFrame, cycle: str, label: str, votes: str, entity: Column, stage: str | None = None) -> DataFrame:
    """AG4: share of each mapped label among all votes of the cycle; the window runs over aggregated rows.

    ``stage`` names a column of which only ``general`` rows (in any case) count.
    """
    if stage:
        df = df.where(F.lower(F.trim(stage)) == "general")
    sums = df.groupBy(cycle, label).agg(F.sum(lenient_number(F.col(votes))).alias("_votes"))
    whole = F.sum("_votes").over(Window.partitionBy(cycle))
    shared = sums.withColumn("_total", whole).where(F.col("_total") != 0)
    return shared.select(
        entity.alias("country"), F.col(cycle).cast("int").alias("election_year"), F.col(label).alias("party"),
        (F.coalesce("_votes", F.lit(0.0)) / F.col("_total") * 100).alias("actual_pct"),
    )


def map_names(df: DataFrame, name: str, out: str, mapping: dict[str, str] = NOMINEES, other: str = "OTHER") -> DataFrame:
    """CL26: full-name match, else last-word match (first map entry wins), else ``other``."""
    spark = df.sparkSession
    by_last: dict[str, str] = {}
    for full, target in mapping.items():
        by_last.setdefault(full.split()[-1], target)
    exact = spark.createDataFrame(list(mapping.items()), f"{name} string, _exact string")
    last = spark.createDataFrame(list(by_last.items()), "_last string, _by_last string")
    keyed = df.withColumn("_last", F.regexp_extract(F.col(name), r"(?U)(\S+)\s*$", 1))
    joined = keyed.join(F.broadcast(exact), name, "left").join(F.broadcast(last), "_last", "left")
    return joined.withColumn(out, F.coalesce("_exact", "_by_last", F.lit(other))).drop("_last", "_exact", "_by_last")


def candidate_averages(df: DataFrame, entity: str, source_table: str, national: str = "National") -> DataFrame:
    """CL25: national rows of a candidate-average file in the schema of cleaned polls."""
    rows = map_names(df.where(F.col("state") == national), "candidate_name", "party")
    return rows.select(
        F.lit(entity).alias("country"),
        F.col("cycle").cast("int").alias("election_year"),
        F.col("modeldate").alias("date_raw"),
        F.lit(None).cast("string").alias("pollster"),
        F.lit(None).cast("string").alias("sample_size"),
        "party",
        F.col("pct_estimate").cast("double").alias("pct"),
        F.lit(source_table).alias("source_table"),
    )


def unmapped_report(df: DataFrame, by: list[str], column: str = "party", other: str = "OTHER") -> DataFrame:
    """CL27."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col(column) == other).alias("unmapped"))
