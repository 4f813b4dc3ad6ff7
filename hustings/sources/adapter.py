"""Canonical poll tables derived from a TPC-H-like star schema (used by the registered queries and the tests)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rawtables import SERIES_LABELS
from ..schemas import ENTITY_CYCLE, SERIES_KEYS

TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
ORDER = ["poll_date", *TIES]
PARTIES = ["AF", "AO", "NF", "NO", "RF", "RO"]
REGIONS = ["africa", "america", "asia", "europe", "middle east"]


#: Declared types of the tables read most; a declared schema needs no footer job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def polls(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Line items as poll readings: region is the entity, ship year the cycle, flag and status the series."""
    places = (
        load(spark, sf_dir, "nation")
        .join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.lower("r_name").alias("country"))
    )
    sources = (
        load(spark, sf_dir, "supplier")
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "country", F.col("s_name").alias("pollster"))
    )
    lines = load(spark, sf_dir, "lineitem").join(sources, F.col("l_suppkey") == F.col("s_suppkey"))
    day = F.col("l_shipdate").cast("date")
    return lines.select(
        "country",
        F.year(day).alias("election_year"),
        F.concat("l_returnflag", "l_linestatus").alias("party"),
        day.alias("poll_date"),
        (F.col("l_quantity") * 2.0).alias("pct"),
        "pollster",
        F.concat(F.lit("lot_"), (F.col("l_partkey") % 20).cast("string")).alias("source_table"),
        _date_text(day, F.col("l_orderkey")).alias("date_raw"),
        *TIES,
        *extra,
    )


def _date_text(day: Column, key: Column) -> Column:
    """The same day written in six ways, two of them without a year."""
    start = F.greatest(F.day(day) - 1, F.lit(1)).cast("string")
    shapes = [
        F.date_format(day, "M/d/yyyy"),
        F.date_format(day, "MMMM d, yyyy"),
        F.date_format(day, "d MMM yyyy"),
        F.concat(start, F.lit("-"), F.date_format(day, "d MMM yyyy")),
        F.concat(start, F.lit("–"), F.date_format(day, "d MMM")),
        F.date_format(day, "d MMM"),
    ]
    out = F.when(key % 6 == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        out = out.when(key % 6 == i, shape)
    return out


def marked_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_markers(polls(spark, sf_dir))


def with_markers(df: DataFrame) -> DataFrame:
    """Polls in which some rows are result lines, in the date text or in the source column."""
    kind = F.col("l_orderkey") % 200
    marker = kind.isin(7, 47, 87, 127, 167)
    date_raw = (
        F.when(kind == 7, "Voting results")
        .when(kind == 47, "Election [3]")
        .when(kind == 87, F.concat("date_raw", F.lit(" election")))
        .otherwise(F.col("date_raw"))
    )
    pollster = (
        F.when(kind == 127, F.concat(F.col("election_year").cast("string"), F.lit(" general election")))
        .when(kind == 167, F.concat((F.col("election_year") - 4).cast("string"), F.lit(" general election")))
        .otherwise(F.col("pollster"))
    )
    pct = F.when(marker, 16.5 + (F.col("l_partkey") % 20) * 0.4).otherwise(F.col("pct"))
    return df.withColumns({"date_raw": date_raw, "pollster": pollster, "pct": pct})


def election_dates(polls_df: DataFrame) -> DataFrame:
    """A cutoff on 1 November of every cycle."""
    cycles = polls_df.select(*ENTITY_CYCLE).distinct()
    return cycles.withColumn("election_date", F.make_date("election_year", F.lit(11), F.lit(1)))


def actuals(polls_df: DataFrame) -> DataFrame:
    """Truth: price-weighted share of each series in its cycle."""
    votes = polls_df.groupBy(*SERIES_KEYS).agg(F.sum("l_extendedprice").alias("votes"))
    share = 100.0 * F.col("votes") / F.sum("votes").over(Window.partitionBy(*ENTITY_CYCLE))
    return votes.select(*SERIES_KEYS, share.alias("actual_pct"))


def overrides(polls_df: DataFrame) -> DataFrame:
    """Reviewed decisions for some lots: lot 5 admitted, lot 1 withdrawn."""
    lots = polls_df.where(F.col("source_table").isin("lot_5", "lot_1")).select(*ENTITY_CYCLE, "source_table").distinct()
    admitted = F.col("source_table") == "lot_5"
    return lots.select(
        "*",
        F.when(admitted, "manual_approved").otherwise("manual_rejected").alias("override_status"),
        F.when(admitted, "reviewed by hand").otherwise("regional coverage").alias("reason"),
        F.lit("adapter rule").alias("evidence"),
    )


def adapter_labels(spark: SparkSession) -> DataFrame:
    """One label whitelist for every region."""
    rows = [(region, k, v) for region in REGIONS for k, v in SERIES_LABELS["uk"].items()]
    return spark.createDataFrame(rows, "country string, label string, canonical string")


#: Raw-table shapes by kind (lot modulo 8): headers, and the extra lines between header and data.
PLAIN = ["Date(s) conducted", "Pollster", "Sample size", "Con", "Lab", "LD", "SNP", "Green", "UKIP", "Lead"]
HEADERS = {
    0: PLAIN,
    1: [*PLAIN[:9], "Seats won"],
    2: ["Date(s) conducted", "Pollster", "Area", *PLAIN[3:]],
    3: ["Date", "Pollster", "Sample size", *["Primary vote"] * 4, "2pp vote", "2pp vote", "Lead"],
    4: PLAIN,
    5: PLAIN,
    6: [*PLAIN[:4], "Leader A", "Leader B", "Leader C", "Leader D", "Leader E", "Lead"],
    7: [*PLAIN[:6], "Lib Dem", "Green", "UKIP", "Lead"],
    8: ["Date(s) conducted", "Pollster", "Con"],
    9: ["Date", "Pollster", "Sample size", *["Primary vote"] * 4, "2pp vote", "2pp vote", "Lead"],
    10: PLAIN,
    11: ["Date(s) conducted", "Pollster", "Area", *PLAIN[3:]],
}
EXTRA_LINES = {
    3: [["Date", "Pollster", "Sample size", "Con", "Lab", "LD", "SNP", "Con", "Lab", "Unnamed: 9_level_1"]],
    4: [PLAIN, ["Unnamed: 0_level_1", *PLAIN[1:]]],
}
EXTRA_LINES |= {9: EXTRA_LINES[3], 10: EXTRA_LINES[4]}


def raw_kind(lot: Column) -> Column:
    """Shape of a lot's raw tables. The last four lots have too few columns, two lines below a second header, two lines below
    junk lines, and no national lines."""
    return F.when(lot >= 16, lot - 8).otherwise(lot % 8)




def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide raw tables: one per region, year and lot, one line per order, one column per series.

    Built from one aggregation; header and extra lines are added per table. Line order is the order key. Kinds 9 and 10 add
    all their orders up to two lines, for odd and even keys.
    """
    lines = polls(spark, sf_dir)
    lot = F.substring("source_table", 5, 9).cast("int")
    table = F.concat(
        F.replace("country", F.lit(" "), F.lit("")), F.lit("_"), F.col("election_year").cast("string"), F.lit("_table"),
        lot.cast("string"), F.lit(".csv"),
    )
    keyed = lines.withColumns({"source_table": table, "kind": raw_kind(lot)})
    line = F.when(F.col("kind").isin(9, 10), F.col("l_orderkey") % 2).otherwise(F.col("l_orderkey"))
    wide = keyed.withColumn("l_orderkey", line).groupBy("source_table", "country", "election_year", "kind", "l_orderkey").agg(
        F.min("poll_date").alias("day"),
        F.min("pollster").alias("who"),
        F.sum("l_quantity").alias("size"),
        *[F.max(F.when(F.col("party") == p, F.col("l_quantity"))).alias(p) for p in PARTIES],
    )
    date_cell = F.when(F.col("kind") == 5, F.concat(F.lit("wave "), F.day("day").cast("string"), F.lit("b"))).otherwise(
        F.date_format("day", "d MMM yyyy")
    )
    area = F.when(F.col("l_orderkey") % 3 == 0, "GB").when(F.col("l_orderkey") % 3 == 1, "Scotland").otherwise("National")
    area = F.when(F.col("kind") == 11, "Scotland").otherwise(area)
    third = F.when(F.col("kind").isin(2, 11), area).otherwise((F.col("size") * 10).cast("int").cast("string"))
    shares = [F.concat(F.col(p).cast("int").cast("string"), F.lit("%")) for p in PARTIES]
    data = wide.select(
        "source_table", "country", "election_year", (F.col("l_orderkey") + 10).alias("row_idx"),
        F.when(F.col("kind") == 8, F.array(date_cell, F.col("who"), shares[0]))
        .otherwise(F.array(date_cell, F.col("who"), third, *shares, F.lit("3"))).alias("cells"),
    )
    fixed = [(k, 0, h) for k, h in HEADERS.items()]
    fixed += [(k, i + 1, line) for k, extra in EXTRA_LINES.items() for i, line in enumerate(extra)]
    shapes = spark.createDataFrame(fixed, "kind int, row_idx bigint, cells array<string>")
    tables = keyed.select("source_table", "country", "election_year", "kind").distinct()
    heads = tables.join(F.broadcast(shapes), "kind").select(*data.columns)
    return data.unionByName(heads)
