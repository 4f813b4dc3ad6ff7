"""Registered queries on scope governance and on true outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as AG
from ..operators import ordering as WN
from ..operators import quality as QC
from ..operators import results as RE
from ..operators import scope as S
from ..sources import adapter as A
from ..sizing import settled
from . import frames as FR
from .core import query, rounded
from .fragments import with_fragments as sql

CANDIDATE = """country, election_year, source_table, date_raw, marker_relevance, marker_text, marker_party_rows, national_overlap_parties,
  round(marker_mae, 6) AS marker_mae, round(marker_max_abs_error, 6) AS marker_max_abs_error, matched_parties"""
AUDIT = """country, election_year, source_table, poll_party_rows, party_count, party_signature, marker_candidate_count, best_marker_date_raw,
  best_marker_relevance, national_overlap_parties, round(marker_mae, 6) AS marker_mae, round(marker_max_abs_error, 6) AS marker_max_abs_error,
  scope_status, scope_reason"""


@query("AG5 AG6 JN7 GV1", sql("candidates", f"SELECT {CANDIDATE} FROM candidates"))
def marker_candidates(spark, sf):
    return rounded(FR.candidates(spark, sf))


@query("WN8", sql("best", f"SELECT {CANDIDATE} FROM best"))
def best_candidate(spark, sf):
    return rounded(S.best_candidates(FR.candidates(spark, sf)))


@query("GV2", sql("audit", "SELECT scope_status, scope_reason, count(*) AS n FROM audit GROUP BY 1, 2"))
def scope_classify(spark, sf):
    return FR.audit(spark, sf).groupBy("scope_status", "scope_reason").agg(F.count("*").alias("n"))


@query("AG7 GV3", sql("audit", f"SELECT {AUDIT} FROM audit"))
def lot_audit(spark, sf):
    return rounded(FR.audit(spark, sf))


ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("JN2 SC8", sql("decided", f"SELECT country, election_year, party, {', '.join(ID)}, effective_scope_status, effective_scope_reason FROM decided"))
def scope_effective(spark, sf):
    return FR.decided(spark, sf).select(
        "country", "election_year", "party", *ID, "effective_scope_status", "effective_scope_reason"
    )


SUMMARY = "country, election_year, source_table, scope_status, override_status, effective_scope_status, effective_scope_reason, evidence"


def _applied(spark, sf):
    marked = A.marked_polls(spark, sf)
    known = FR.audit(spark, sf).where(F.col("source_table") != "lot_19")
    return S.apply_scope(marked, known, A.overrides(marked))


@query("GV4 AG8 SC9", sql("decided", f"SELECT {SUMMARY}, count(*) AS poll_party_rows FROM decided WHERE effective_scope_status IN ('approved_marker_match', 'manual_approved') GROUP BY ALL"))
def scope_included_lots(spark, sf):
    return _applied(spark, sf)[2]


@query("GV4 AG8", sql("decided", f"SELECT {SUMMARY}, count(*) AS poll_party_rows FROM decided WHERE effective_scope_status NOT IN ('approved_marker_match', 'manual_approved') GROUP BY ALL"))
def scope_excluded_lots(spark, sf):
    return _applied(spark, sf)[3]


@query("GV4", sql("decided", "SELECT country, party, count(*) AS n FROM decided WHERE effective_scope_status IN ('approved_marker_match', 'manual_approved') GROUP BY 1, 2"))
def scope_approved_rows(spark, sf):
    return _applied(spark, sf)[0].groupBy("country", "party").agg(F.count("*").alias("n"))


@query("AG25", sql("audit", """SELECT count(*) AS source_tables, count(DISTINCT country) AS countries, count(DISTINCT (country, election_year)) AS elections,
  CAST(sum(poll_party_rows) AS BIGINT) AS poll_party_rows, count(*) FILTER (scope_status = 'approved_marker_match') AS approved,
  count(*) FILTER (scope_status = 'rejected_marker_mismatch') AS rejected, count(*) FILTER (scope_status = 'review') AS review FROM audit"""))
def scope_kpis(spark, sf):
    return AG.scope_kpis(FR.audit(spark, sf))


@query("AG26", sql("audit", """SELECT country, scope_status, count(*) AS source_tables, CAST(sum(poll_party_rows) AS BIGINT) AS poll_party_rows,
  round(100.0 * sum(poll_party_rows) / sum(sum(poll_party_rows)) OVER (), 6) AS row_share_pct FROM audit GROUP BY 1, 2"""))
def status_composition(spark, sf):
    return rounded(AG.composition(FR.audit(spark, sf), ["country", "scope_status"]))


@query("AG27", sql("audit", """SELECT country, scope_status, source_table, CAST(sum(poll_party_rows) AS BIGINT) AS poll_party_rows, count(*) AS source_tables,
  CAST(grouping(country, scope_status, source_table) AS INTEGER) AS level FROM audit GROUP BY ROLLUP (country, scope_status, source_table)"""))
def scope_rollup(spark, sf):
    return AG.hierarchy_totals(FR.audit(spark, sf), ["country", "scope_status", "source_table"])


@query("AG28", sql("audit", "SELECT coalesce(nullif(scope_reason, ''), 'Other reviewed table') AS reason, count(*) AS source_tables, CAST(sum(poll_party_rows) AS BIGINT) AS poll_party_rows FROM audit GROUP BY 1"))
def reason_totals(spark, sf):
    return AG.reason_totals(FR.audit(spark, sf))


@query("AG29", sql("audit", "SELECT country, CAST(sum(poll_party_rows) AS BIGINT) AS poll_party_rows, CAST(sum(marker_candidate_count) AS BIGINT) AS marker_candidate_count FROM audit GROUP BY country"))
def country_totals(spark, sf):
    return AG.totals(FR.audit(spark, sf), ["country"], ["poll_party_rows", "marker_candidate_count"])


# ---- true outcomes ---------------------------------------------------------------------------------------------

@query("AG1", sql("polls", """SELECT 'all' AS country, election_year, party, round(100.0 * v / t, 6) AS actual_pct FROM (
   SELECT election_year, sum(l_extendedprice) FILTER (party = 'AF') AS "AF", sum(l_extendedprice) FILTER (party = 'NO') AS "NO", 0.0::DOUBLE AS "ZZ", sum(l_extendedprice) AS t
   FROM polls GROUP BY election_year) UNPIVOT (v FOR party IN ("AF", "NO", "ZZ"))"""))
def weighted_share(spark, sf):
    """Districts are suppliers' lines; series' votes over all votes, blanks where a series did not stand, one unreadable."""
    votes = [F.when(F.col("party") == p, F.col("l_extendedprice")).cast("string").alias(f"{p}_votes") for p in ("AF", "NO")]
    wide = A.polls(spark, sf).select("election_year", "l_extendedprice", *votes, F.lit("n/a").alias("ZZ_votes"))
    return rounded(RE.weighted_share(wide, "election_year", {"AF": "AF_votes", "NO": "NO_votes", "ZZ": "ZZ_votes"}, "l_extendedprice", F.lit("all")))


@query("AG2", sql("polls", """SELECT 'all' AS country, election_year, party, round(100.0 * v / (b + coalesce(c, 0) + l), 6) AS actual_pct FROM (
   SELECT election_year, b, c, l, b AS "BQ", c AS "CPC", l AS "LPC" FROM (
   SELECT election_year, sum(l_extendedprice) FILTER (party = 'AF') AS b, sum(l_extendedprice) FILTER (party = 'AO' AND election_year % 2 = 1) AS c,
     sum(l_extendedprice) FILTER (party = 'NF') AS l FROM polls GROUP BY election_year)) UNPIVOT (v FOR party IN ("BQ", "CPC", "LPC"))"""))
def share_of_present_columns(spark, sf):
    """A file per cycle; those of even years lack one of the columns."""
    columns = {"Bloc": "AF", "ConParty": "AO", "Lib": "NF"}
    votes = {c: F.when(F.col("party") == p, F.col("l_extendedprice")).alias(c) for c, p in columns.items()}
    polls = A.polls(spark, sf)
    files = [(polls.where(F.col("election_year") == y).select(*[v for c, v in votes.items() if y % 2 or c != "ConParty"]), y) for y in range(1995, 2002)]
    return rounded(RE.present_column_shares(files, F.lit("all")))


@query("AG3 RS1", sql("polls", """SELECT 'all' AS country, election_year, UNNEST([{'party': 'A (2PP)', 'actual_pct': round(a, 6)}, {'party': 'B (2PP)', 'actual_pct': round(100 - a, 6)}], recursive := true)
  FROM (SELECT election_year, 100.0 * sum(l_extendedprice) FILTER (party LIKE 'A%') / sum(l_extendedprice) AS a FROM polls GROUP BY 1)"""))
def ready_shares(spark, sf):
    """Published two-way shares per cycle, one column per side."""
    side = F.sum(F.when(F.col("party").startswith("A"), F.col("l_extendedprice")))
    published = A.polls(spark, sf).groupBy("election_year").agg((100.0 * side / F.sum("l_extendedprice")).alias("a_pct"))
    published = published.withColumn("b_pct", 100 - F.col("a_pct"))
    return rounded(RE.ready_shares(published, "election_year", {"A (2PP)": "a_pct", "B (2PP)": "b_pct"}, F.lit("all")))


NAMES = """CASE l_suppkey % 6 WHEN 0 THEN 'Donald Trump' WHEN 1 THEN 'Hillary Clinton' WHEN 2 THEN 'Trump' WHEN 3 THEN 'Ross Perot'
  WHEN 4 THEN 'George H. W. Bush' ELSE 'Chelsea Clinton' END"""
MAPPED = "CASE l_suppkey % 6 WHEN 0 THEN 'REP' WHEN 1 THEN 'DEM' WHEN 2 THEN 'REP' WHEN 3 THEN 'OTHER' WHEN 4 THEN 'REP' ELSE 'DEM' END"


def _candidates(spark, sf):
    names = ["Donald Trump", "Hillary Clinton", "Trump", "Ross Perot", "George H. W. Bush", "Chelsea Clinton"]
    kind = F.col("l_suppkey") % 6
    who = F.when(kind == 0, names[0])
    for i, n in enumerate(names[1:], 1):
        who = who.when(kind == i, n)
    return A.load(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("cycle"), who.alias("candidate_name"), F.col("l_extendedprice").alias("votes"),
        F.when(F.col("l_linenumber") == 1, "National").otherwise("Ohio").alias("state"), F.when(F.col("l_linenumber") % 3 == 0, "primary").otherwise("General").alias("stage"),
        F.col("l_shipdate").cast("date").cast("string").alias("modeldate"), F.col("l_quantity").alias("pct_estimate"),
    )


@query("AG4 CL26", f"""SELECT 'us' AS country, CAST(cycle AS INTEGER) AS election_year, party, round(100.0 * v / sum(v) OVER (PARTITION BY cycle), 6) AS actual_pct
  FROM (SELECT year(l_shipdate) AS cycle, {MAPPED} AS party, sum(l_extendedprice) AS v FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1, 2)""")
def share_by_mapped_label(spark, sf):
    named = RE.map_names(_candidates(spark, sf), "candidate_name", "party")
    return rounded(RE.share_by_label(named, "cycle", "party", "votes", F.lit("us"), stage="stage"))


@query("CL25 CL26", f"""SELECT 'us' AS country, CAST(year(l_shipdate) AS INTEGER) AS election_year, strftime(l_shipdate, '%Y-%m-%d') AS date_raw, NULL::VARCHAR AS pollster,
  NULL::VARCHAR AS sample_size, {MAPPED} AS party, l_quantity AS pct, 'averages.csv' AS source_table FROM lineitem WHERE l_linenumber = 1""")
def candidate_averages(spark, sf):
    return RE.candidate_averages(_candidates(spark, sf), "us", "averages.csv")


@query("CL27", f"SELECT CAST(year(l_shipdate) AS INTEGER) AS election_year, count(*) AS rows, count(*) FILTER ({MAPPED} = 'OTHER') AS unmapped FROM lineitem WHERE l_linenumber = 1 GROUP BY 1")
def unmapped_names(spark, sf):
    return RE.unmapped_report(RE.candidate_averages(_candidates(spark, sf), "us", "averages.csv"), ["election_year"])


@query("QC9", sql("actuals", """SELECT country, election_year, party, CAST(expected AS DOUBLE) AS expected, round(actual_pct, 6) AS actual_pct, abs(actual_pct - expected) <= 1.0 AS within
  FROM (VALUES ('asia', 1998, 'AF', 16.7), ('asia', 1999, 'AF', 90.0), ('nowhere', 1999, 'AF', 1.0)) v(country, election_year, party, expected)
  LEFT JOIN actuals USING (country, election_year, party)"""))
def anchor_check(spark, sf):
    anchors = spark.createDataFrame(
        [("asia", 1998, "AF", 16.7), ("asia", 1999, "AF", 90.0), ("nowhere", 1999, "AF", 1.0)],
        "country string, election_year int, party string, expected double",
    )
    keys = ["country", "election_year", "party"]
    return rounded(QC.anchor_check(FR.truth(spark, sf), anchors, keys, "actual_pct", 1.0))
