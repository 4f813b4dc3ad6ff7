"""Registered queries on reporting tables, reshaping, selections and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..operators import aggregates as AG
from ..operators import ordering as WN
from ..operators import reshape as RS
from ..plans import marts as P
from ..session import scratch_path
from ..sizing import settled
from ..sources import adapter as A
from ..sources import files, sinks
from . import frames as FR
from .core import query, rounded
from .fragments import with_fragments as sql

KEYS = ["country", "election_year", "party"]
CYCLE = ["country", "election_year"]

# One row per cycle with labels, as PR1 gives it.
PERFORMANCE = """, perf AS (SELECT country, country_label, iso_alpha, election_year, CASE dataset_split WHEN 'holdout' THEN 'Holdout' ELSE 'Development' END AS split,
    election_mae, winner_correct, CASE winner_correct WHEN 1 THEN 'Correct winner' ELSE 'Winner miss' END AS result_status, actual_winner, predicted_winner,
    printf('%.2f', election_mae) || CASE winner_correct WHEN 1 THEN ' OK' ELSE ' MISS' END AS annotation FROM calls JOIN metadata USING (country))
  """
PARTY_ERRORS = """, perr AS (SELECT country, country_label, election_year, country_label || ' ' || CAST(election_year AS VARCHAR) AS election_label, party,
    CASE is_winner WHEN 1 THEN 'Election winner' ELSE 'Other modelled party' END AS party_role,
    CASE dataset_split WHEN 'holdout' THEN 'Holdout' ELSE 'Development' END AS evaluation_split, dataset_split, actual_pct,
    final_rolling_avg AS predicted_pct, baseline_error AS signed_error, baseline_abs_error AS absolute_error, n_poll_observations, poll_std,
    greatest(coalesce(poll_std, 0), 0) + 0.25 AS bubble_size, campaign_span_days, recent_30d_observations FROM oof JOIN metadata USING (country))
  """


def _party_errors(spark, sf):
    df = FR.settled_dataset(spark, sf)
    return P.party_errors(FR.development(df), FR.holdout(df), df, FR.metadata(spark))


@query("PR1 ST2 SC13 SC14 SC18", sql("calls metadata", PERFORMANCE + "SELECT * REPLACE (round(election_mae, 6) AS election_mae) FROM perf").replace("\n, perf", ", perf"))
def election_performance(spark, sf):
    return rounded(FR.performance(spark, FR.settled_dataset(spark, sf)))


@query("PR2 JN10 AG21 AG22 AG23 WN6", sql("calls metadata oof", (PERFORMANCE + """SELECT e.country, country_label, iso_alpha, poll_observations, campaign_party_rows, evaluated_party_rows, elections, correct_winners,
    wrong_winners, round(winner_accuracy, 6) AS winner_accuracy, round(winner_accuracy * 100, 6) AS winner_accuracy_pct, round(mean_absolute_error, 6) AS mean_absolute_error,
    round(median_absolute_error, 6) AS median_absolute_error, round(maximum_absolute_error, 6) AS maximum_absolute_error, worst_election,
    round(worst_election_mae, 6) AS worst_election_mae, worst_election_result_status
  FROM (SELECT country, count(*) AS evaluated_party_rows, avg(baseline_abs_error) AS mean_absolute_error, median(baseline_abs_error) AS median_absolute_error,
          max(baseline_abs_error) AS maximum_absolute_error, CAST(sum(n_poll_observations) AS BIGINT) AS poll_observations, count(*) AS campaign_party_rows FROM oof GROUP BY 1) e
  JOIN (SELECT country, country_label, iso_alpha, count(*) AS elections, CAST(sum(winner_correct) AS BIGINT) AS correct_winners, CAST(count(*) - sum(winner_correct) AS BIGINT) AS wrong_winners,
          avg(winner_correct) AS winner_accuracy FROM perf GROUP BY 1, 2, 3) w ON e.country = w.country
  JOIN (SELECT country, country_label || ' ' || CAST(election_year AS VARCHAR) AS worst_election, election_mae AS worst_election_mae, result_status AS worst_election_result_status
        FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY election_mae DESC, election_year) AS rn FROM perf) WHERE rn = 1) x ON e.country = x.country""")).replace("\n, perf", ", perf"))
def country_performance(spark, sf):
    df = FR.settled_dataset(spark, sf)
    errors = P.party_errors(FR.development(df), FR.holdout(df), df, FR.metadata(spark))
    return rounded(P.country_performance(FR.performance(spark, df), errors, df))


@query("PR3 DT22", sql("rolling splits dataset metadata", """SELECT r.country, country_label, r.election_year, country_label || ' ' || CAST(r.election_year AS VARCHAR) AS election_label,
    s.dataset_split, r.party, strftime(r.poll_date, '%Y-%m-%d') AS poll_date, r.pct, round(r.rolling_avg, 6) AS rolling_avg, r.momentum_1st_diff, r.momentum_2nd_diff,
    d.actual_pct IS NOT NULL AS model_included, round(d.actual_pct, 6) AS actual_pct, coalesce(d.is_winner, 0) AS is_winner, d.n_poll_observations, round(d.poll_std, 6) AS poll_std
  FROM rolling r LEFT JOIN splits s ON r.country = s.country AND r.election_year = s.election_year
  LEFT JOIN (SELECT * FROM dataset WHERE party <> 'RO') d ON r.country = d.country AND r.election_year = d.election_year AND r.party = d.party
  JOIN metadata m ON r.country = m.country"""))
def trajectory_table(spark, sf):
    """The rolling rows are written once; the modelling table and the trajectories are both read from them."""
    campaign = FR.campaign(spark, sf)
    df = settled(FR.campaign_dataset(campaign)).where("party <> 'RO'")
    return rounded(P.trajectories(campaign.rolling, campaign.splits, df, FR.metadata(spark)))


@query("PR4 ST2 SC15", sql("oof metadata", (PARTY_ERRORS + """SELECT * REPLACE (round(actual_pct, 6) AS actual_pct, round(predicted_pct, 6) AS predicted_pct, round(signed_error, 6) AS signed_error,
    round(absolute_error, 6) AS absolute_error, round(poll_std, 6) AS poll_std, round(bubble_size, 6) AS bubble_size) FROM perr""").replace("\n, perr", ", perr")))
def party_error_table(spark, sf):
    return rounded(_party_errors(spark, sf))


@query("PR5 TK4", sql("rolling", "SELECT count(*) AS observations, count(DISTINCT party) AS parties, min(poll_date) AS first_poll, max(poll_date) AS last_poll FROM rolling WHERE country = 'asia' AND election_year = 1998 AND party IN ('AF', 'NO')"))
def trajectory_slice(spark, sf):
    return P.trajectory_kpis(P.trajectory_slice(FR.rolling(spark, sf), "asia", 1998, ["AF", "NO"]))


@query("TK4", sql("polls", "SELECT party FROM (SELECT DISTINCT party FROM polls) ORDER BY party LIMIT 4"))
def default_selection_fallback(spark, sf):
    return WN.default_selection(A.polls(spark, sf).withColumn("model_included", F.lit(False)), "model_included")


@query("TK4", sql("polls", "SELECT DISTINCT party FROM polls WHERE party LIKE 'N%'"))
def default_selection(spark, sf):
    return WN.default_selection(A.polls(spark, sf).withColumn("model_included", F.col("party").startswith("N")), "model_included")


@query("PR7", sql("oof calls", """SELECT o.country, o.election_year, party, round(o.actual_pct, 6) AS actual_pct, round(baseline_vote_prediction, 6) AS selected_vote_prediction,
    round(baseline_error, 6) AS vote_share_error, round(baseline_abs_error, 6) AS absolute_error, CAST(actual_place AS INTEGER) AS place, actual_winner, predicted_winner, winner_correct,
    round(predicted_margin, 6) AS predicted_margin, round(actual_margin, 6) AS actual_margin
  FROM oof o JOIN calls c ON o.country = c.country AND o.election_year = c.election_year WHERE o.country = 'europe' AND o.election_year = 2000"""))
def case_study(spark, sf):
    from ..operators.models import election_results

    held = FR.holdout(FR.settled_dataset(spark, sf))
    return rounded(P.case_study(election_results(held, "selected_vote_prediction"), held, "europe", 2000))


@query("PR8 AG30", sql("oof metadata", (PARTY_ERRORS + """SELECT count(*) AS rows, count(DISTINCT (country, election_year)) AS elections, round(avg(absolute_error), 6) AS mae,
    round(avg(signed_error), 6) AS mean_signed_error, round(max(absolute_error), 6) AS max_absolute_error FROM perr WHERE evaluation_split = 'Holdout' AND country IN ('asia', 'africa')""").replace("\n, perr", ", perr")))
def filtered_kpis(spark, sf):
    chosen = P.optional_filters(_party_errors(spark, sf), evaluation_split="Holdout", country=["asia", "africa"], party_role="All", election_year=None)
    return rounded(AG.slice_kpis(chosen))


@query("AG24", sql("calls metadata", (PERFORMANCE + "SELECT country, split, count(*) AS elections, round(avg(election_mae), 6) AS mean_election_mae, CAST(sum(winner_correct) AS BIGINT) AS correct_winners FROM perf GROUP BY 1, 2").replace("\n, perf", ", perf")))
def split_country_summary(spark, sf):
    return rounded(AG.split_summary(FR.performance(spark, FR.settled_dataset(spark, sf)), ["country", "split"]))


@query("AG21", sql("errors", "SELECT country, count(*) AS evaluated_party_rows, round(avg(abs_error), 6) AS mean_absolute_error, round(max(abs_error), 6) AS maximum_absolute_error, round(median(abs_error), 6) AS median_absolute_error FROM errors GROUP BY 1"))
def error_summary(spark, sf):
    return rounded(AG.error_summary(FR.errors(spark, sf), ["country"], "abs_error"))


@query("AG22", sql("block", "SELECT country, CAST(sum(n_poll_observations) AS BIGINT) AS poll_observations, count(*) AS campaign_party_rows FROM block GROUP BY 1"))
def volume_summary(spark, sf):
    return AG.volume_summary(FR.dataset(spark, sf), ["country"])


@query("AG23", sql("calls", "SELECT country, count(*) AS elections, CAST(sum(winner_correct) AS BIGINT) AS correct_winners, CAST(count(*) - sum(winner_correct) AS BIGINT) AS wrong_winners, round(avg(winner_correct), 6) AS winner_accuracy, CAST(sum(winner_correct) AS BIGINT) || '/' || count(*) || ' correct' AS record FROM calls GROUP BY 1"))
def winner_record(spark, sf):
    record = AG.winner_record(FR.performance(spark, FR.settled_dataset(spark, sf)), ["country"])
    return rounded(record.withColumn("record", SC.winner_record_text(F.col("correct_winners"), F.col("elections"))))


@query("WN6", sql("calls", "SELECT country, election_year, round(election_mae, 6) AS election_mae FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY election_mae DESC, election_year) AS rn FROM calls) WHERE rn = 1"))
def worst_election(spark, sf):
    perf = FR.performance(spark, FR.settled_dataset(spark, sf))
    return rounded(WN.best_row(perf, ["country"], [F.col("election_mae").desc(), F.col("election_year")], ["election_year", "election_mae"]))


@query("RS1", sql("dataset", "SELECT country, election_year, party, measure, round(value, 6) AS value FROM (SELECT country, election_year, party, actual_pct, final_rolling_avg FROM dataset) UNPIVOT (value FOR measure IN (actual_pct, final_rolling_avg))"))
def melt_measures(spark, sf):
    return rounded(RS.melt_measures(FR.dataset(spark, sf), KEYS, ["actual_pct", "final_rolling_avg"]))


@query("RS3", sql("calls", """SELECT country, round(max(election_mae) FILTER (election_year = 1995), 6) AS "1995",
  round(max(election_mae) FILTER (election_year = 1996), 6) AS "1996",
  round(max(election_mae) FILTER (election_year = 1997), 6) AS "1997",
  round(max(election_mae) FILTER (election_year = 1998), 6) AS "1998",
  round(max(election_mae) FILTER (election_year = 1999), 6) AS "1999",
  round(max(election_mae) FILTER (election_year = 2000), 6) AS "2000",
  round(max(election_mae) FILTER (election_year = 2001), 6) AS "2001" FROM calls GROUP BY country"""))
def country_year_matrix(spark, sf):
    perf = FR.performance(spark, FR.settled_dataset(spark, sf))
    return rounded(RS.entity_cycle_matrix(perf, "election_mae", cycles=list(range(1995, 2002))))


@query("ST1 ST3", sql("dates", "SELECT DISTINCT country, election_year FROM dates"))
def union_distinct(spark, sf):
    dates = FR.dates(spark, sf).select(*CYCLE)
    return RS.union_all(dates, dates.where("election_year > 1998")).dropDuplicates()


@query("ST4", sql("polls", "SELECT DISTINCT party FROM polls EXCEPT SELECT party FROM polls WHERE party LIKE 'A%'"))
def label_difference(spark, sf):
    df = A.polls(spark, sf)
    return RS.label_difference(df, df.where("party LIKE 'A%'"), "party")


@query("TK1", sql("dataset", "SELECT country, election_year, party, round(actual_pct, 6) AS actual_pct FROM dataset ORDER BY country, election_year, actual_pct DESC"))
def ordered_output(spark, sf):
    return rounded(FR.dataset(spark, sf).select(*KEYS, "actual_pct")).orderBy("country", "election_year", F.desc("actual_pct"), "party")


# ---- exports ---------------------------------------------------------------------------------------------------

@query("IO2 IO4 IO5 IO11", sql("polls", "SELECT country, election_year, party, CAST(count(*) AS BIGINT) AS n, round(sum(pct), 6) AS total FROM polls GROUP BY 1, 2, 3"))
def csv_round_trip(spark, sf):
    """Cleaned polls written as CSV parts and read back with their declared types."""
    rows = A.polls(spark, sf).select(*KEYS, "pct")
    path = scratch_path(spark, "polls-csv")
    sinks.write_csv(rows, path)
    back = files.read_many(spark, [path], "country string, election_year int, party string, pct double")
    return rounded(back.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("pct").alias("total")))


@query("IO6", sql("calls", "SELECT country, election_year, printf('%.6f', election_mae) AS election_mae FROM calls"))
def fixed_decimals(spark, sf):
    perf = FR.performance(spark, FR.settled_dataset(spark, sf))
    return sinks.fixed_decimals(perf.select(*CYCLE, "election_mae"))


@query("IO7", sql("polls", "SELECT '{\"country\":\"' || country || '\",\"party\":\"' || party || '\",\"n\":' || CAST(count(*) AS VARCHAR) || ',\"note\":null}' AS record FROM polls GROUP BY country, party"))
def json_export(spark, sf):
    counts = A.polls(spark, sf).groupBy("country", "party").agg(F.count("*").alias("n"))
    return sinks.json_records(counts.withColumn("note", F.lit(None).cast("string")))


@query("IO8", """SELECT 'events.json' AS name, 'events.parquet' AS source, count(*) AS rows, 'event_id,ts,user_id,event_type,value,props' AS columns FROM events
  UNION ALL SELECT 'regions.json', 'region.parquet', count(*), 'r_regionkey,r_name' FROM region""")
def export_manifest(spark, sf):
    """Both tables written once as JSON; their rows are counted on the way."""
    tables = {"events.json": ("events.parquet", A.load(spark, sf, "events")), "regions.json": ("region.parquet", A.load(spark, sf, "region"))}
    return sinks.export_tables(tables, scratch_path(spark, "export"))


@query("IO10", sql("dataset calls", """SELECT 'final_polling_average' AS selected_model, 'final_rolling_avg' AS prediction_column, 'lowest error' AS selection_basis,
    (SELECT round(avg(abs(final_rolling_avg - actual_pct)), 6) FROM dataset) AS development_mae,
    (SELECT round(sqrt(avg(pow(final_rolling_avg - actual_pct, 2))), 6) FROM dataset) AS development_rmse,
    (SELECT round(avg(winner_correct), 6) FROM calls) AS development_winner_accuracy, 'rejected' AS challenger_decision, 'once' AS holdout_usage"""))
def decision_record(spark, sf):
    from .model_queries import _metrics

    record = sinks.decision_record(_metrics(spark, sf), "final_polling_average", "final_rolling_avg", "lowest error", "rejected", "once")
    # The JSON record is read back field by field; numbers in its text carry all digits.
    fields = "selected_model string, prediction_column string, selection_basis string, development_mae double, development_rmse double, development_winner_accuracy double, challenger_decision string, holdout_usage string"
    return rounded(record.select(F.from_json("record", fields).alias("r")).select("r.*"))


@query("IO9", sql("calls", "SELECT country, election_year, winner_correct FROM calls WHERE dataset_split = 'holdout'"))
def stored_once(spark, sf):
    """Holdout results written to a path that must not exist, then read back."""
    from ..operators.models import election_results

    held = FR.holdout(FR.settled_dataset(spark, sf))
    path = scratch_path(spark, "holdout")
    sinks.write_once(election_results(held, "selected_vote_prediction").select(*CYCLE, "winner_correct"), path)
    return spark.read.parquet(path)
