"""Registered queries on wide raw tables. The oracles know how each table was made, not how it is cleaned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import rawtables as RT
from ..session import cut_lineage, scratch_path
from ..sources import adapter as A
from ..sources import files
from .core import query, rounded
from .fragments import with_fragments as sql

LINES = """, lines AS (SELECT replace(country, ' ', '') || '_' || CAST(election_year AS VARCHAR) || '_table' || substr(source_table, 5) || '.csv' AS source_table, country, election_year,
    CASE WHEN CAST(substr(source_table, 5) AS INTEGER) >= 16 THEN CAST(substr(source_table, 5) AS INTEGER) - 8 ELSE CAST(substr(source_table, 5) AS INTEGER) % 8 END AS kind,
    CASE WHEN CAST(substr(source_table, 5) AS INTEGER) IN (17, 18) THEN l_orderkey % 2 ELSE l_orderkey END AS l_orderkey, min(poll_date) AS day, min(pollster) AS who, CAST(sum(l_quantity) * 10 AS INTEGER) AS size,
    max(l_quantity) FILTER (party = 'AF') AS a1, max(l_quantity) FILTER (party = 'AO') AS a2, max(l_quantity) FILTER (party = 'NF') AS a3,
    max(l_quantity) FILTER (party = 'NO') AS a4, max(l_quantity) FILTER (party = 'RF') AS a5, max(l_quantity) FILTER (party = 'RO') AS a6
    FROM polls GROUP BY ALL),
  national AS (SELECT * FROM lines WHERE kind <> 11 AND (kind <> 2 OR l_orderkey % 3 <> 1)),
  tables AS (SELECT source_table, country, election_year, kind, count(*) AS n, count(*) FILTER (kind <> 11 AND (kind <> 2 OR l_orderkey % 3 <> 1)) AS n_national, CASE WHEN kind IN (3, 9) THEN 1 WHEN kind IN (4, 10) THEN 2 ELSE 0 END AS extra,
      max(CAST(a1 IS NOT NULL AND nat AS INTEGER)) + max(CAST(a2 IS NOT NULL AND nat AS INTEGER)) + max(CAST(a3 IS NOT NULL AND nat AS INTEGER))
      + max(CAST(a4 IS NOT NULL AND nat AS INTEGER)) + max(CAST(a5 IS NOT NULL AND nat AS INTEGER)) + max(CAST(a6 IS NOT NULL AND nat AS INTEGER)) AS filled,
      max(CAST(a1 IS NOT NULL AND nat AS INTEGER)) AS first_filled
    FROM (SELECT *, kind <> 11 AND (kind <> 2 OR l_orderkey % 3 <> 1) AS nat FROM lines) GROUP BY 1, 2, 3, 4),
  decided AS (SELECT *, CASE
      WHEN n + extra < 3 OR kind = 8 THEN 'too small'
      WHEN kind = 1 THEN 'seat-count/projection table, not vote-share data'
      WHEN kind IN (3, 9) AND n < 3 THEN 'too small after subheader harvest'
      WHEN kind IN (4, 10) AND n < 3 THEN 'too small after junk-row removal'
      WHEN kind = 5 THEN 'no column looks like dates'
      WHEN kind IN (2, 11) AND n_national = 0 THEN 'no national-level rows after area filter'
      WHEN kind = 6 THEN 'fewer than 2 recognised party columns found (got ' || CAST(first_filled AS VARCHAR) || ')'
      WHEN filled < 2 THEN 'fewer than 2 recognised party columns found (got ' || CAST(filled AS VARCHAR) || ')'
      ELSE 'ok' END AS status FROM tables)
  """
MELT = """SELECT DISTINCT country, election_year, strftime(day, '%-d %b %Y') AS date_raw, who AS pollster, sample_size, party, pct, source_table FROM (
    SELECT l.*, CASE WHEN l.kind = 2 THEN NULL ELSE CAST(size AS VARCHAR) END AS sample_size, UNNEST([
      {'party': CASE l.kind WHEN 3 THEN 'CON (Primary)' ELSE 'CON' END, 'pct': a1}, {'party': CASE l.kind WHEN 3 THEN 'LAB (Primary)' ELSE 'LAB' END, 'pct': a2},
      {'party': CASE l.kind WHEN 3 THEN 'LD (Primary)' ELSE 'LD' END, 'pct': a3}, {'party': CASE l.kind WHEN 3 THEN 'SNP (Primary)' WHEN 7 THEN 'LD' ELSE 'SNP' END, 'pct': a4},
      {'party': CASE l.kind WHEN 3 THEN 'CON (2PP)' ELSE 'GRN' END, 'pct': a5}, {'party': CASE l.kind WHEN 3 THEN 'LAB (2PP)' ELSE 'UKIP' END, 'pct': a6}], recursive := true)
    FROM national l JOIN decided d ON l.source_table = d.source_table WHERE status = 'ok') WHERE pct IS NOT NULL"""


def _raw(spark, sf):
    """Raw tables stored once, as scraped files would be; admission reads them several times."""
    return cut_lineage(A.raw_rows(spark, sf))


def _lines(body: str) -> str:
    return sql("polls", LINES + body).replace("\n, lines", ", lines")


@query("CL1", _lines("""SELECT source_table, country, election_year, n + extra AS n_rows,
  n + extra >= 3 AS admitted FROM tables"""))
def scrape_admission(spark, sf):
    """Every table of the adapter has two columns with digits, its dates and a share, so that the rows decide."""
    return RT.admissible_scrape(A.raw_rows(spark, sf)).select("source_table", "country", "election_year", "n_rows", "admitted")


@query("CL2 CL3 CL4 CL5 CL6 CL7 CL8 CL9 CL10 CL11 CL12 CL13 CL14 CL16 CL17 WN12", _lines("SELECT source_table, country, election_year, status FROM decided"))
def table_admission(spark, sf):
    decided, _, _ = RT.profile_tables(_raw(spark, sf), A.adapter_labels(spark))
    return decided.select("source_table", "country", "election_year", "status")


@query("CL24", _lines("SELECT status, count(*) AS tables FROM decided GROUP BY status"))
def skip_reasons(spark, sf):
    decided, _, _ = RT.profile_tables(_raw(spark, sf), A.adapter_labels(spark))
    return RT.skip_report(decided)


@query("CL12 CL15 CL18 CL19 CL20 CL21 CL22 CL23", _lines(MELT))
def cleaned_observations(spark, sf):
    return rounded(RT.clean_tables(_raw(spark, sf), A.adapter_labels(spark))[0])


@query("IO1", _lines("SELECT source_table, country, election_year, n + extra AS lines, CAST(CASE kind WHEN 8 THEN 3 ELSE 10 END AS INTEGER) AS width FROM (SELECT * REPLACE (replace(country, ' ', '') AS country) FROM tables)"))
def raw_file_rows(spark, sf):
    """Every wide table written as files with differing headers, read back with names, line numbers and widths.

    A table is stored as one file per million order keys, each with the table's header line, so no file and no
    writing task grows with the table.
    """
    raw = _raw(spark, sf)
    number = F.floor(F.greatest(F.col("row_idx") - 10, F.lit(0)) / 1_000_000)
    numbered = raw.withColumn("part", F.lpad(number.cast("string"), 6, "0"))
    heads = raw.where("row_idx = 0").join(numbered.select("source_table", "part").distinct(), "source_table")
    lines = numbered.where("row_idx > 0").unionByName(heads)
    file = F.concat(F.replace("source_table", F.lit(".csv"), F.lit("")), "part", F.lit(".csv"))
    cells = [F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(10)]
    path = scratch_path(spark, "raw-files")
    placed = lines.withColumn("source_table", file).repartition("source_table")
    placed.sortWithinPartitions("source_table", "row_idx").select("source_table", *cells).write.partitionBy(
        "source_table"
    ).option("header", False).csv(path)
    back = files.read_raw_rows(spark, path, 12, r"^part-.*\.csv$", by_folder=True)
    table = F.regexp_replace("source_table", r"\d{6}\.csv$", ".csv")
    return (
        back.where(F.col("row_idx") > 0)
        .groupBy(table.alias("source_table"), "country", "election_year")
        .agg(F.count("*").alias("lines"), F.max(F.size("cells")).alias("width"))
    )


@query("CL20 CL15 CL7", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'CON' WHEN 1 THEN 'LD (2PP)' WHEN 2 THEN 'LAB (Primary)' WHEN 3 THEN 'GRN' WHEN 4 THEN 'LEADER A'
  WHEN 5 THEN 'SF' WHEN 6 THEN 'PC' ELSE 'X Y (2PP)' END AS party FROM events""")
def label_canon(spark, sf):
    names = ["Con[a]", "Lib Dem (2PP)", "Labour (Primary)", "Green.1", "Leader A", " Sinn Fein ", "plaid cymru.2", "x y (2PP)"]
    kind = F.col("event_id") % 8
    label = F.when(kind == 0, names[0])
    for i, n in enumerate(names[1:], 1):
        label = label.when(kind == i, n)
    rows = A.load(spark, sf, "events").select("event_id", label.alias("name"), F.lit("uk").alias("country"))
    return RT.canonical_labels(rows, RT.label_table(spark), "name", "party").select("event_id", "party")


@query("CL21", "SELECT event_id, CASE WHEN event_id % 9 < 4 THEN round(value, 2) END AS pct FROM events")
def pct_parse(spark, sf):
    value = F.format_string("%.2f", "value")
    forms = [F.concat(value, F.lit("%")), F.concat(F.lit(" "), value, F.lit(" % ")), F.concat(F.lit("–"), value), value, F.lit("—"), F.concat(value, F.lit("[a]")),
        F.concat(value, F.lit("d")), F.concat(value, F.lit("f%")), F.lit("0x1p3")]
    kind = F.col("event_id") % 9
    cell = F.when(kind == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        cell = cell.when(kind == i, f)
    return rounded(A.load(spark, sf, "events").select("event_id", TX.parse_percent(cell).alias("pct")))


@query("CL22", "SELECT doc_id, length(text) AS n_chars, text AS repaired FROM documents")
def mojibake_repair(spark, sf):
    """Texts whose dashes and apostrophes were encoded twice, repaired; all other text stays as it is."""
    text = F.col("text")
    for bad, good in TX.MOJIBAKE[:2]:
        text = F.replace(text, F.lit(good), F.lit(bad))
    out = A.load(spark, sf, "documents").select("doc_id", TX.repair_mojibake(text).alias("repaired"))
    return out.select("doc_id", F.length("repaired").cast("bigint").alias("n_chars"), "repaired")


@query("CL5 CL7", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_orderkey % 4 WHEN 0 THEN '2PP' WHEN 1 THEN 'Primary' WHEN 2 THEN 'Primary' END AS tag,
  CASE l_orderkey % 4 WHEN 0 THEN 'Two-party vote' WHEN 1 THEN 'Primary vote' WHEN 2 THEN 'Political parties' ELSE 'Pollster' END AS base FROM lineitem""")
def header_tags(spark, sf):
    names = ["Two-party vote.1", "Primary vote", "Political parties.12", "Pollster.3"]
    kind = F.col("l_orderkey") % 4
    header = F.when(kind == 0, names[0]).when(kind == 1, names[1]).when(kind == 2, names[2]).otherwise(names[3])
    rows = A.load(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", TX.metric_tag(header).alias("tag"), TX.base_name(header).alias("base"))


@query("IO3", """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN 'Caf' || chr(129) || 'é ' ELSE 'Café “3 €” – ' END || s_name || ', Łódź'[:CASE s_suppkey % 3 WHEN 0 THEN 6 ELSE 0 END] AS label,
  CASE s_suppkey % 3 WHEN 1 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier""")
def mixed_encodings(spark, sf):
    """Suppliers written as CSV in three encodings, one with a further column, read back as one frame."""
    rows = A.load(spark, sf, "supplier").withColumn("label", F.concat(F.lit("Café “3 €” – "), "s_name"))
    path = scratch_path(spark, "encodings")
    kind = F.col("s_suppkey") % 3
    utf8 = rows.where(kind == 0).select("s_suppkey", F.concat("label", F.lit(", Łódź")).alias("label"))
    western = rows.where(kind == 1).select("s_suppkey", F.translate("label", files.C1_PRINTED, files.C1_CODES).alias("label"), F.col("s_nationkey").alias("nation"))
    latin = rows.where(kind == 2).select("s_suppkey", F.concat(F.lit("Caf\x81é "), "s_name").alias("label"))
    for name, part, charset in (("utf8", utf8, "UTF-8"), ("western", western, "ISO-8859-1"), ("latin", latin, "ISO-8859-1")):
        part.write.option("header", True).option("encoding", charset).csv(f"{path}/{name}")
    return files.read_csv_any_encoding(spark, [f"{path}/{name}" for name in ("utf8", "western", "latin")])


@query("IO12 IO4", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer")
def marked_headers(spark, sf):
    """Customers written with a byte-order mark before the first header of every part, read back with declared types."""
    rows = A.load(spark, sf, "customer").select(F.col("c_custkey").alias("\ufeffc_custkey"), "c_name")
    path = scratch_path(spark, "marked")
    rows.write.option("header", True).csv(path)
    return files.read_csv(spark, path, "c_custkey bigint, c_name string")
