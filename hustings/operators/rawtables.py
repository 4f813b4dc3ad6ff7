"""Admission and cleaning of wide raw tables (CL1-CL24).

A raw table stays one row per data line with its cells in an array, so row rules are array expressions and need no
shuffle. Table rules are partial aggregates per table; a very large table is therefore never held by one task. The
first test a table fails names its skip reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bind, with_poll_date
from ..functions.text import (
    PERCENT_CELL,
    base_name,
    clean_label,
    label_and_tag,
    metric_tag,
    missing_to_null,
    parse_percent,
    repair_mojibake,
    strip,
)
from ..session import cut_lineage
from ..sizing import settled
from .ordering import first_cells, first_n_non_null

TABLE = ["source_table", "country", "election_year"]
# Area cells that mean the whole country, and header words that never name a series.
NATIONAL_AREAS = ["uk", "gb", "national", "nationwide", "great britain", "aus", "australia", "can", "canada"]
NON_SERIES_WORDS = [
    "date(s) conducted", "date", "pollster/client(s)", "pollster", "area", "sample size", "lead", "others", "client",
    "fieldwork date", "polling firm", "firm", "region", "notes", "unnamed",
]
# Recognised series labels per entity and their canonical form.
SERIES_LABELS = {
    "uk": {
        "con": "CON", "conservative": "CON", "lab": "LAB", "labour": "LAB", "ld": "LD", "lib dem": "LD",
        "libdem": "LD", "snp": "SNP", "pc": "PC", "plaid cymru": "PC", "ukip": "UKIP", "brx": "BRX", "brexit": "BRX",
        "grn": "GRN", "green": "GRN", "chg": "CHG", "change": "CHG", "bnp": "BNP", "bgpv": "BGPV", "dup": "DUP",
        "gpni": "GPNI", "reform": "REFORM", "sf": "SF", "sinn fein": "SF", "sdlp": "SDLP", "uup": "UUP",
        "alliance": "ALLIANCE",
    },
    "canada": {
        "cpc": "CPC", "con": "CPC", "conservative": "CPC", "lpc": "LPC", "lib": "LPC", "liberal": "LPC", "ndp": "NDP",
        "bq": "BQ", "bloc": "BQ", "gpc": "GPC", "grn": "GPC", "green": "GPC", "ppc": "PPC", "pc": "PC",
        "other": "OTHER",
    },
    "australia": {
        "alp": "ALP", "labor": "ALP", "labour": "ALP", "l/np": "L/NP", "coalition": "L/NP", "lnp": "L/NP",
        "lib/nat": "L/NP", "lib": "LIB", "liberal": "LIB", "nat": "NAT", "national": "NAT", "nationals": "NAT",
        "grn": "GRN", "greens": "GRN", "on": "ONP", "onp": "ONP", "one nation": "ONP", "uap": "UAP", "other": "OTHER",
        "oth": "OTHER",
    },
}
# Skip reasons, in the order the tests are made.
TOO_SMALL = "too small"
SEATS = "seat-count/projection table, not vote-share data"
SMALL_AFTER_HARVEST = "too small after subheader harvest"
SMALL_AFTER_JUNK = "too small after junk-row removal"
NO_DATES = "no column looks like dates"
NO_NATIONAL = "no national-level rows after area filter"


def label_table(spark, labels: dict[str, dict[str, str]] = SERIES_LABELS) -> DataFrame:
    """CL16: the whitelist as a small frame (entity, label, canonical)."""
    rows = [(e, k, v) for e, pairs in labels.items() for k, v in pairs.items()]
    return spark.createDataFrame(rows, "country string, label string, canonical string")


def mangle_repeats(names: Column) -> Column:
    """CL4: the second ``X`` becomes ``X.1``, the third ``X.2``."""

    def numbered(name: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(names, 1, i), lambda other: other == name))
        return F.when(seen > 0, F.concat(name, F.lit("."), seen.cast("string"))).otherwise(name)

    return F.transform(names, numbered)


def header_names(cells: Column) -> Column:
    """CL4: names of the header line; a blank becomes ``Unnamed: i``."""
    named = F.transform(cells, lambda c, i: F.coalesce(c, F.concat(F.lit("Unnamed: "), i.cast("string"))))
    return mangle_repeats(named)


def _lower(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.lower(strip(F.coalesce(c, F.lit("nan")))))


def harvested_names(header: Column, first: Column) -> Column:
    """CL6 / CL7: names taken from the first data row for repeated group headers, NULL where not taken."""
    bases = F.transform(header, base_name)

    def taken(name: Column, i: Column) -> Column:
        base = F.get(bases, i)
        label = strip(F.get(first, i))
        repeated = F.size(F.filter(bases, lambda b: b == base)) > 1
        real = label.isNotNull() & ~F.lower(label).startswith("unnamed:") & ~F.lower(label).isin("nan", "")
        tag = metric_tag(base)
        named = F.when(tag.isNotNull(), F.concat(label, F.lit(" ("), tag, F.lit(")"))).otherwise(label)
        return F.when(repeated & real & (F.length(label) <= 25), named)

    return F.transform(header, taken)


def first_index(names: Column, words: list[str], whole: bool = False) -> Column:
    """CL10 / CL18: position of the first name that contains (or is) one of the words, NULL when none."""

    def hit(name: Column) -> Column:
        tests = [(name == w) if whole else name.contains(w) for w in words]
        return reduce(lambda a, b: a | b, tests)

    places = F.transform(names, lambda n, i: F.when(hit(n), i))
    return F.array_min(places)


def admissible_scrape(raw: DataFrame) -> DataFrame:
    """CL1: tables with three data rows or more and at least two columns whose cells mostly carry digits."""
    data = raw.where(F.col("row_idx") > 0)
    rows = data.groupBy(*TABLE).agg(F.count("*").alias("n_rows"))
    cells = data.select(*TABLE, F.posexplode("cells").alias("col_idx", "value"))
    share = F.avg(F.coalesce(F.col("value").rlike(r"\d"), F.lit(False)).cast("int"))
    columns = cells.groupBy(*TABLE, "col_idx").agg(share.alias("digit_share"))
    numeric = columns.groupBy(*TABLE).agg(F.count_if(F.col("digit_share") > 0.3).alias("numeric_columns"))
    joined = rows.join(numeric, TABLE)
    return joined.withColumn("admitted", (F.col("n_rows") >= 3) & (F.col("numeric_columns") >= 2))


def with_table_names(raw: DataFrame) -> DataFrame:
    """CL2-CL7, CL10, CL12, CL18: one row per table with its final names and the columns that play a role."""
    data = F.col("row_idx") > 0
    sizes = raw.groupBy(*TABLE).agg(
        F.count_if(data).alias("n_rows"), F.min(F.when(data, F.col("row_idx"))).alias("_start")
    )
    # Only the header line and the first data line of each table carry their cells into the aggregation.
    heads = raw.join(sizes, TABLE).where((F.col("row_idx") == 0) | (F.col("row_idx") == F.col("_start")))
    tables = heads.groupBy(*TABLE, "n_rows").agg(
        F.max(F.when(~data, F.col("cells"))).alias("_head"),
        F.max(F.when(data, F.struct("row_idx", "cells"))).alias("_first"),
    )
    tables = tables.withColumn("header", header_names(F.transform("_head", missing_to_null)))
    tables = tables.withColumn(
        "_taken", harvested_names(F.col("header"), F.transform("_first.cells", missing_to_null))
    ).withColumn("harvested", F.exists("_taken", lambda t: t.isNotNull()))
    renamed = mangle_repeats(F.transform("header", lambda h, i: F.coalesce(F.get(F.col("_taken"), i), h)))
    tables = tables.withColumn("names", F.when(F.col("harvested"), renamed).otherwise(F.col("header")))
    low = F.transform("names", lambda n: F.lower(strip(n)))
    return (
        tables.withColumn("low", low)
        .withColumns(
            {
                "n_cols": F.size("header"),
                "has_seats": F.exists("header", lambda h: F.lower(h).contains("seat")),
                "rows_after_harvest": F.col("n_rows") - F.col("harvested").cast("int"),
                "first_kept": F.when(F.col("harvested"), F.col("_first.row_idx") + 1).otherwise(F.lit(1)),
                "date_idx": F.coalesce(first_index(F.col("low"), ["date"]), F.lit(0)),
                "area_idx": first_index(F.col("low"), ["area", "region"], whole=True),
                "pollster_idx": first_index(F.col("low"), ["pollster", "client", "firm"]),
                "sample_idx": first_index(F.col("low"), ["sample"]),
            }
        )
        .drop("_head", "_first", "_taken")
    )


def rows_with_names(raw: DataFrame, tables: DataFrame) -> DataFrame:
    """Data rows with their table's names; a row is junk when it repeats names or carries ``unnamed:`` (CL8)."""
    named = raw.where(F.col("row_idx") > 0).join(tables, TABLE)
    kept = named.where(F.col("row_idx") >= F.col("first_kept")).withColumn("cells", F.transform("cells", missing_to_null))
    junk = bind(
        _lower(F.col("cells")),
        lambda low: (F.size(F.array_intersect(low, "low")) >= 2) | F.exists(low, lambda c: c.contains("unnamed:")),
    )
    area = F.lower(strip(F.get("cells", F.col("area_idx"))))
    national = F.col("area_idx").isNull() | F.coalesce(area.isin(NATIONAL_AREAS), F.lit(False))
    return kept.withColumns({"junk": junk, "national": national})


def profile_tables(raw: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CL2-CL17: (table decisions, accepted series columns, rows).

    The per-table frames are settled as they come, so the lines are read four times and nothing is derived twice.
    Decisions hold ``status``: ``ok`` or the first failed test.
    """
    tables = settled(with_table_names(raw))
    rows = rows_with_names(raw, tables)
    starts = settled(rows.where(~F.col("junk")).groupBy(*TABLE).agg(F.min("row_idx").alias("first_good")))
    body = rows.join(starts, TABLE).where(F.col("row_idx") >= F.col("first_good"))
    sizes = body.groupBy(*TABLE).agg(
        F.count("*").alias("rows_after_junk"), F.count_if("national").alias("national_rows")
    )
    sample = first_cells(body.select(*TABLE, "national", "date_idx", "row_idx", "cells"), [*TABLE, "national", "date_idx"], "row_idx")
    sample = cut_lineage(sample)  # at most thirty cells per column, read twice
    dates = first_n_non_null(sample.where(F.col("col_idx") == F.col("date_idx")), TABLE, "row_idx", "value")
    parsed = with_poll_date(dates, date_raw="value")
    date_proof = parsed.groupBy(*TABLE).agg(F.avg(F.col("poll_date").isNotNull().cast("int")).alias("date_share"))
    percents = (
        sample.where("national")
        .groupBy(*TABLE, "col_idx")
        .agg(F.avg(F.col("value").rlike(PERCENT_CELL).cast("int")).alias("percent_share"))
    )
    listed = tables.select(*TABLE, F.posexplode("low").alias("col_idx", "low_name"), "names")
    listed = listed.withColumn("name", F.get("names", F.col("col_idx"))).drop("names")
    reserved = reduce(lambda a, b: a | b, [F.col("low_name").contains(w) for w in NON_SERIES_WORDS])
    known = labels.withColumnRenamed("label", "_label")
    series = (
        listed.where(~reserved)
        .join(percents.where(F.col("percent_share") > 0.5), [*TABLE, "col_idx"])
        .withColumn("_label", clean_label(F.col("name")))
        .join(known, ["country", "_label"])
        .select(*TABLE, "col_idx", "name")
    )
    series = settled(series)
    found = series.groupBy(*TABLE).agg(F.count("*").alias("series_columns"))
    decided = tables
    for part in (sizes, date_proof, found):
        decided = decided.join(part, TABLE, "left")
    n = F.coalesce("series_columns", F.lit(0))
    few = F.concat(F.lit("fewer than 2 recognised party columns found (got "), n.cast("string"), F.lit(")"))
    status = (
        F.when((F.col("n_rows") < 3) | (F.col("n_cols") < 4), TOO_SMALL)
        .when(F.col("has_seats"), SEATS)
        .when(F.col("rows_after_harvest") < 3, SMALL_AFTER_HARVEST)
        .when(F.coalesce("rows_after_junk", F.lit(0)) < 3, SMALL_AFTER_JUNK)
        .when(~(F.coalesce("date_share", F.lit(0.0)) > 0.5), NO_DATES)
        .when(F.coalesce("national_rows", F.lit(0)) == 0, NO_NATIONAL)
        .when(n < 2, few)
        .otherwise("ok")
    )
    decided = settled(decided.withColumn("status", status).select(*TABLE, "n_rows", "n_cols", "status"))
    return decided, series, body


def melt_tables(decided: DataFrame, series: DataFrame, body: DataFrame, labels: DataFrame) -> DataFrame:
    """CL19-CL22: observations of the accepted tables, one per row and series column."""
    wanted = (
        series.join(decided.where(F.col("status") == "ok").select(*TABLE), TABLE, "left_semi")
        .groupBy(*TABLE)
        .agg(F.collect_list(F.struct("col_idx", "name")).alias("_series"))
    )
    rows = body.where("national").join(wanted, TABLE)
    long = rows.select(
        *TABLE,
        F.get("cells", F.col("date_idx")).alias("date_raw"),
        F.get("cells", F.col("pollster_idx")).alias("pollster"),
        F.get("cells", F.col("sample_idx")).alias("sample_size"),
        F.explode(F.transform("_series", lambda s: F.struct(s["name"].alias("name"), F.get("cells", s["col_idx"]).alias("cell")))).alias("_o"),
    ).select("*", F.col("_o.name").alias("name"), parse_percent(F.col("_o.cell")).alias("pct"))
    canonical = canonical_labels(long.where(F.col("pct").isNotNull()), labels, "name", "party")
    return canonical.select(
        "country",
        "election_year",
        repair_mojibake(F.col("date_raw")).alias("date_raw"),
        repair_mojibake(F.col("pollster")).alias("pollster"),
        "sample_size",
        repair_mojibake(F.col("party")).alias("party"),
        "pct",
        "source_table",
    )


def canonical_labels(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    """CL20: canonical label (upper case when unknown), with its metric tag kept."""
    label, tag = label_and_tag(F.col(column))
    known = labels.select("country", F.col("label").alias("_label"), "canonical")
    keyed = df.withColumns({"_label": clean_label(label), "_tag": tag})
    joined = keyed.join(known, ["country", "_label"], "left")
    named = F.coalesce("canonical", F.upper("_label"))
    return joined.withColumn(out, F.when(F.col("_tag") != "", F.concat_ws(" ", named, "_tag")).otherwise(named)).drop(
        "_label", "_tag", "canonical"
    )


def clean_tables(raw: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CL2-CL23: (distinct observations, table decisions)."""
    decided, series, body = profile_tables(raw, labels)
    return melt_tables(decided, series, body, labels).dropDuplicates(), decided


def skip_report(decided: DataFrame) -> DataFrame:
    """CL24."""
    return decided.groupBy("status").agg(F.count("*").alias("tables"))
