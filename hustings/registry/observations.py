"""Registered queries on observations: dates, scalars, rolling windows, cutoffs, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import scalars as SC
from ..functions import text as TX
from ..operators import aggregates as AG
from ..operators import joins as JN
from ..operators import ordering as WN
from ..operators.quantiles import box_summary, histogram
from ..operators.rolling import last_observation, rolling_features
from ..plans import dataset as D
from ..sources import adapter as A
from . import frames as FR
from .core import query, rounded
from .fragments import with_fragments as sql

KEYS = ["country", "election_year", "party"]
ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


# ---- rolling windows -------------------------------------------------------------------------------------------

@query("WN1 JN11", sql("rolling", f"SELECT country, election_year, party, poll_date, {', '.join(ID)}, pct, round(rolling_avg, 6) AS rolling_avg FROM rolling"))
def rolling_mean_5(spark, sf):
    return rounded(FR.rolling(spark, sf).select(*KEYS, "poll_date", *ID, "pct", "rolling_avg"))


@query("WN2 WN3", sql("rolling", f"SELECT country, election_year, party, {', '.join(ID)}, momentum_1st_diff, momentum_2nd_diff FROM rolling"))
def finite_differences(spark, sf):
    return rounded(FR.rolling(spark, sf).select(*KEYS, *ID, "momentum_1st_diff", "momentum_2nd_diff"))


@query("WN1 WN2 WN3", sql("rolling", f"SELECT country, election_year, party, {', '.join(ID)}, round(rolling_avg, 6) AS rolling_avg, momentum_1st_diff, momentum_2nd_diff FROM rolling"))
def rolling_in_chunks(spark, sf):
    """Series cut into chunks of about 50 rows."""
    retained, _ = JN.split_at_cutoff(A.polls(spark, sf), FR.dates(spark, sf))
    out = rolling_features(retained, A.ORDER, rows_per_task=50)
    return rounded(out.select(*KEYS, *ID, "rolling_avg", "momentum_1st_diff", "momentum_2nd_diff"))


@query("WN4", sql("last_rows", "SELECT country, election_year, party, last_poll_date AS poll_date, final_poll_pct AS pct, round(final_rolling_avg, 6) AS rolling_avg FROM last_rows"))
def last_observations(spark, sf):
    return rounded(last_observation(FR.rolling(spark, sf), A.ORDER, ["poll_date", "pct", "rolling_avg"]))


@query(
    "WN10",
    sql("splits", "SELECT * FROM splits"),
)
def holdout_split(spark, sf):
    return FR.splits(spark, sf)


@query("WN11", sql("splits", "SELECT country, election_year, CAST(row_number() OVER (ORDER BY country, election_year) AS INTEGER) AS fold_number FROM splits WHERE dataset_split = 'development'"))
def fold_numbers(spark, sf):
    return WN.numbered_folds(FR.splits(spark, sf).where("dataset_split = 'development'"), ["country", "election_year"])


@query(
    "WN12",
    """SELECT country, source_table, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
         SELECT lower(r_name) AS country, 'lot_' || CAST(l_partkey % 20 AS VARCHAR) AS source_table, l_orderkey, l_linenumber,
           l_partkey, l_suppkey, row_number() OVER (PARTITION BY r_name, l_partkey % 20
             ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey WHERE l_discount > 0) WHERE rn <= 15""",
)
def first_values(spark, sf):
    rows = A.polls(spark, sf, ("l_discount",)).withColumn("v", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    rows = rows.select("country", "source_table", *ID, "v", F.struct(*ID).alias("at"))
    return WN.first_n_non_null(rows, ["country", "source_table"], "at", "v").select(
        "country", "source_table", *ID[:4]
    )


@query("WN13", sql("rolling targets", "SELECT t.country, t.election_year, t.party, round(actual_pct, 6) AS actual_pct, marker_date FROM targets t JOIN (SELECT country, election_year, max(poll_date) AS marker_date FROM rolling GROUP BY 1, 2) m ON t.country = m.country AND t.election_year = m.election_year"))
def series_markers(spark, sf):
    rows = JN.many_to_one(FR.rolling(spark, sf), FR.truth(spark, sf), KEYS)
    return rounded(WN.running_marker(rows, ["country", "election_year"]))


# ---- cutoff ----------------------------------------------------------------------------------------------------

RETAINED = f"SELECT country, election_year, party, poll_date, pct, election_date, {', '.join(ID)} FROM "


@query("JN11", sql("retained", RETAINED + "retained"))
def cutoff_retained(spark, sf):
    kept, _ = JN.split_at_cutoff(A.polls(spark, sf), FR.dates(spark, sf))
    return kept.select(*KEYS, "poll_date", "pct", "election_date", *ID)


@query("GV5 JN11", sql("removed", "SELECT country, election_year, source_table, date_raw, pollster, party, pct, poll_date, election_date FROM removed"))
def cutoff_excluded(spark, sf):
    _, removed = JN.split_at_cutoff(A.polls(spark, sf), FR.dates(spark, sf))
    return removed.select(
        "country", "election_year", "source_table", "date_raw", "pollster", "party", "pct", "poll_date", "election_date"
    )


@query("JN11 QC3", sql("polls dates", "SELECT p.country, p.election_year, count(*) AS kept FROM polls p JOIN dates USING (country, election_year) WHERE poll_date < election_date GROUP BY ALL"))
def cutoff_strict(spark, sf):
    kept, _ = JN.split_at_cutoff(A.polls(spark, sf), FR.dates(spark, sf), strict=True)
    return kept.groupBy("country", "election_year").agg(F.count("*").alias("kept"))


# ---- dates -----------------------------------------------------------------------------------------------------

MONTH_LAST = "CAST(date_trunc('month', ship) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE)"


def _date_cases(spark, sf):
    """Every accepted way of writing a day, and texts that must give none, from each ship date."""
    day = F.col("l_shipdate").cast("date")
    short = F.date_format(day, "d MMM")
    full = F.date_format(day, "d MMM yyyy")
    month_year = F.date_format(day, "MMMM yyyy")
    forms = [
        F.date_format(day, "M/d/yyyy"), F.date_format(day, "MMMM d, yyyy"), full,
        F.concat(F.lit("1–"), full), F.concat(F.lit("30 Dec 1993 - "), full), F.concat(F.lit("28 Jan — "), full),
        F.concat(F.lit("1-"), short), F.concat(F.lit("28 Jan–"), short), short, month_year,
        F.concat(F.lit("Jan-"), month_year), F.date_format(day, "MMM"), F.concat(full, F.lit(" election")),
        F.concat(F.lit("Early "), full, F.lit("[a]")), F.concat(F.lit("Pre-"), full), F.concat(F.lit("3-4/"), full),
        F.concat(F.lit("31 "), month_year), F.lit("Voting result[4]"),
        F.concat(F.date_format(day, "yyyy"), F.lit(" election")), F.concat(F.lit("wave "), short),
    ]
    kind = F.col("l_orderkey") % len(forms)
    text = F.when(kind == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        text = text.when(kind == i, form)
    return A.load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("date_raw"),
        (F.year(day) + 1).alias("election_year"), F.lit(6).alias("closing_month"),
    )


@query(
    "DT1 DT2 DT3 DT4 DT5 DT6 DT7 DT8 DT9 DT10 DT11 DT12 DT13 DT14 DT15 DT16 DT17 DT18 DT19",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind IN (12, 17, 18) AS is_election_result,
          CAST(CASE WHEN kind IN (0, 1, 2, 3, 4, 5, 12, 13, 14, 15) THEN ship
               WHEN kind IN (6, 7, 8) THEN make_date(y, month(ship), least(day(ship), day(last_day(make_date(y, month(ship), 1)))))
               WHEN kind IN (9, 10) THEN date_trunc('month', ship) WHEN kind = 11 THEN make_date(y, month(ship), 1)
               WHEN kind = 16 THEN {MONTH_LAST} END AS DATE) AS poll_date
        FROM (SELECT *, CAST(l_shipdate AS DATE) AS ship, l_orderkey % 20 AS kind,
                year(l_shipdate) + 1 - CASE WHEN month(l_shipdate) > 6 THEN 1 ELSE 0 END AS y FROM lineitem)""",
)
def date_parse(spark, sf):
    """Texts without a year take the cycle's year, one less for months after the closing month."""
    out = DT.with_poll_date(_date_cases(spark, sf), month_hint="closing_month")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_election_result", "poll_date")


@query(
    "DT20",
    sql(
        "marked",
        f"""SELECT m.country, m.election_year, {', '.join(ID)},
              CASE WHEN date_raw IN ('Voting results', 'Election [3]') THEN NULL
                   WHEN l_orderkey % 6 IN (4, 5) THEN
                     make_date(m.election_year - CASE WHEN month(poll_date) > hint THEN 1 ELSE 0 END, month(poll_date),
                       least(day(poll_date), day(last_day(make_date(m.election_year - CASE WHEN month(poll_date) > hint THEN 1 ELSE 0 END, month(poll_date), 1)))))
                   ELSE poll_date END AS poll_date
            FROM marked m LEFT JOIN (SELECT country, election_year, arg_min(month(poll_date), l_orderkey * 100 + l_linenumber) AS hint
              FROM (SELECT *, count(*) OVER (PARTITION BY country, election_year, l_orderkey, l_linenumber) AS c FROM marked)
              WHERE date_raw LIKE '% election' GROUP BY country, election_year) h
            ON m.country = h.country AND m.election_year = h.election_year""",
    ),
)
def date_two_pass(spark, sf):
    rows = A.marked_polls(spark, sf).withColumn("_at", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    out = DT.with_poll_date_two_pass(rows.drop("poll_date"), ["_at"])
    return out.select("country", "election_year", *ID, "poll_date")


@query(
    "DT21",
    sql(
        "marked",
        """SELECT country, count(*) AS total, count(*) FILTER (date_raw NOT IN ('Voting results', 'Election [3]')) AS parsed,
             round(100.0 * count(*) FILTER (date_raw NOT IN ('Voting results', 'Election [3]')) / count(*), 6) AS parsed_pct
           FROM marked GROUP BY country""",
    ),
)
def date_parse_rate(spark, sf):
    return rounded(DT.parse_rate(DT.with_poll_date(A.marked_polls(spark, sf).drop("poll_date")), ["country"]))


@query("DT21", sql("marked", "SELECT DISTINCT date_raw FROM marked WHERE date_raw IN ('Voting results', 'Election [3]') ORDER BY 1 LIMIT 10"))
def date_parse_failures(spark, sf):
    return DT.unparsed_samples(DT.with_poll_date(A.marked_polls(spark, sf).drop("poll_date")))


@query("DT22", sql("rolling", "SELECT DISTINCT strftime(poll_date, '%Y-%m-%d') AS poll_day FROM rolling"))
def iso_dates(spark, sf):
    return FR.rolling(spark, sf).select(DT.iso_date(F.col("poll_date")).alias("poll_day")).distinct()


# ---- scalars ---------------------------------------------------------------------------------------------------

@query("SC1", sql("polls", "SELECT count(*) AS complete_rows FROM polls WHERE pollster IS NOT NULL AND nullif(pct, 50.0) IS NOT NULL"))
def null_drop(spark, sf):
    rows = A.polls(spark, sf).withColumn("pct", F.nullif("pct", F.lit(50.0)))
    return rows.dropna(subset=["pollster", "pct"]).agg(F.count("*").alias("complete_rows"))


@query("SC2 CL21", """SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 5 = 1 THEN 'nan' WHEN event_id % 7 = 2 THEN value || 'd' WHEN event_id % 7 = 3 THEN value || 'F' WHEN event_id % 7 = 4 THEN '0x1p3' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number
  FROM events WHERE event_id % 5 <> 1 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 1""")
def lenient_cast(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 5 == 1, "nan")
    for at, end in ((2, "d"), (3, "F")):
        text = text.when(F.col("event_id") % 7 == at, F.concat(F.col("value").cast("string"), F.lit(end)))
    text = text.when(F.col("event_id") % 7 == 4, "0x1p3").otherwise(F.col("value").cast("string"))
    return A.load(spark, sf, "events").select("event_id", SC.lenient_number(text).alias("number"))


@query(
    "SC3 SC4",
    sql("polls", """SELECT country, party, CASE WHEN country = 'asia' AND party NOT IN ('AF', 'NO') THEN NULL
      WHEN country = 'europe' AND party = 'RF' THEN 'RX' ELSE party END AS model_party, count(*) AS n FROM polls GROUP BY 1, 2, 3"""),
)
def modelled_series(spark, sf):
    named = SC.modelled_series(F.col("country"), F.col("party"), {("europe", "RF"): "RX"}, {"asia": ["AF", "NO"]})
    return A.polls(spark, sf).groupBy("country", "party", named.alias("model_party")).agg(F.count("*").alias("n"))


@query("SC5", sql("marked", "SELECT country, count(*) AS n FROM marked WHERE pollster IS NOT NULL AND NOT (lower(date_raw) LIKE '%election%' OR lower(date_raw) LIKE '%voting result%' OR lower(pollster) LIKE '%election%') GROUP BY country"))
def named_source_rows(spark, sf):
    return JN.named_sources(A.marked_polls(spark, sf)).groupBy("country").agg(F.count("*").alias("n"))


@query("SC6 SC7 GV1", sql("marker_rows", f"SELECT country, election_year, {', '.join(ID)}, marker_text, marker_relevance FROM marker_rows"))
def marker_rows(spark, sf):
    from ..operators.scope import marker_rows as find

    return find(A.marked_polls(spark, sf)).select("country", "election_year", *ID, "marker_text", "marker_relevance")


@query("SC7", """SELECT doc_id, CASE WHEN len(y) > 0 AND list_contains(y, '2003') THEN 'explicit_current_year' WHEN len(y) > 0 THEN 'historical_other_year'
  ELSE 'generic_current_candidate' END AS relevance FROM (SELECT doc_id, regexp_extract_all(text, '\\b(?:19|20)\\d{2}\\b') AS y FROM documents)""")
def year_relevance(spark, sf):
    docs = A.load(spark, sf, "documents")
    return docs.select("doc_id", TX.marker_relevance(F.col("text"), F.lit(2003)).alias("relevance"))


@query("SC9", sql("polls", "SELECT party, count(*) AS n FROM polls WHERE source_table IN ('lot_1', 'lot_2', 'lot_3') GROUP BY party"))
def membership_filter(spark, sf):
    rows = A.polls(spark, sf).where(F.col("source_table").isin("lot_1", "lot_2", "lot_3"))
    return rows.groupBy("party").agg(F.count("*").alias("n"))


@query("SC10 SC11 JN1", sql("errors", "SELECT country, party, CASE WHEN signed_error > 0 THEN 'Overestimated' ELSE 'Underestimated' END AS direction, count(*) AS n, round(avg(abs_error), 6) AS mean_abs_error FROM errors GROUP BY 1, 2, 3"))
def error_direction(spark, sf):
    joined = JN.many_to_one(A.polls(spark, sf), FR.truth(spark, sf), KEYS)
    scored = SC.with_errors(joined, "pct", "actual_pct", "signed", "absolute")
    grouped = scored.groupBy("country", "party", SC.direction_label(F.col("signed")).alias("direction"))
    return rounded(grouped.agg(F.count("*").alias("n"), F.avg("absolute").alias("mean_abs_error")))


@query("SC12", """SELECT event_type, CASE event_type WHEN 'click' THEN 'Pointer click' ELSE event_type END AS label,
  upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Event' AS title, count(*) AS n FROM events GROUP BY event_type""")
def display_labels(spark, sf):
    grouped = A.load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return grouped.select(
        "event_type",
        SC.lookup_text(F.col("event_type"), {"click": "Pointer click"}).alias("label"),
        SC.title_label(F.concat("event_type", F.lit("_event"))).alias("title"),
        "n",
    )


@query("SC13", sql("polls metadata", "SELECT country, country_label, iso_alpha, count(*) AS n FROM polls JOIN metadata USING (country) GROUP BY ALL"))
def entity_metadata(spark, sf):
    counts = A.polls(spark, sf).groupBy("country").agg(F.count("*").alias("n"))
    return SC.attach_metadata(counts, FR.metadata(spark))


@query("ST4 SC13", sql("polls metadata", "SELECT DISTINCT country FROM polls WHERE country NOT IN (SELECT country FROM metadata WHERE country <> 'asia')"))
def unknown_entities(spark, sf):
    return SC.unknown_entities(A.polls(spark, sf), FR.metadata(spark).where("country <> 'asia'"))


@query("SC14 SC18", sql("calls metadata", """SELECT country, election_year, country_label || ' ' || CAST(election_year AS VARCHAR) AS election_label,
  printf('%.2f', election_mae) || CASE winner_correct WHEN 1 THEN ' OK' ELSE ' MISS' END AS annotation,
  CASE winner_correct WHEN 1 THEN 'Correct winner' ELSE 'Winner miss' END AS result_status FROM calls JOIN metadata USING (country)"""))
def derived_text(spark, sf):
    from ..operators.models import winner_calls

    df = FR.out_of_fold_columns(FR.settled_dataset(spark, sf))
    mae = df.groupBy("country", "election_year").agg(F.avg("baseline_abs_error").alias("mae"))
    calls = SC.attach_metadata(winner_calls(df, "final_rolling_avg").join(mae, ["country", "election_year"]), FR.metadata(spark))
    return calls.select(
        "country", "election_year", SC.cycle_label(F.col("country_label"), F.col("election_year")).alias("election_label"),
        SC.result_annotation(F.col("mae"), F.col("winner_correct")).alias("annotation"),
        SC.status_text(F.col("winner_correct")).alias("result_status"),
    )


@query("SC15", sql("block", "SELECT country, election_year, party, round(greatest(coalesce(recent_30d_trend_per_day, 0), 0) + 0.25, 6) AS bubble, round(sqrt(poll_std), 6) AS radius FROM block"))
def bubble_size(spark, sf):
    df = FR.dataset(spark, sf)
    return rounded(df.select(*KEYS, SC.bubble_size(F.col("recent_30d_trend_per_day")).alias("bubble"), F.sqrt("poll_std").alias("radius")))


@query("SC16", "SELECT event_id, round_even(value, 0) AS half_even FROM events")
def half_even_rounding(spark, sf):
    return A.load(spark, sf, "events").select("event_id", F.bround("value", 0).alias("half_even"))


@query("SC17", sql("polls", "SELECT country, count(*) AS n FROM polls WHERE poll_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' GROUP BY country"))
def dates_between(spark, sf):
    rows = A.polls(spark, sf).where(F.col("poll_date").between(F.lit("1997-03-01").cast("date"), F.lit("1997-03-31").cast("date")))
    return rows.groupBy("country").agg(F.count("*").alias("n"))


# ---- joins with truth and source scores ------------------------------------------------------------------------

@query("JN1", sql("errors", f"SELECT country, election_year, party, {', '.join(ID)}, round(signed_error, 6) AS signed_error, round(abs_error, 6) AS abs_error FROM errors"))
def observation_errors(spark, sf):
    return rounded(FR.errors(spark, sf).select(*KEYS, *ID, "signed_error", "abs_error"))


@query("AG14", sql("errors", "SELECT country, pollster, round(avg(abs_error), 6) AS mean_abs_error, count(*) AS n_polls FROM errors GROUP BY 1, 2 HAVING count(*) >= 5"))
def source_error(spark, sf):
    return rounded(AG.source_errors(FR.errors(spark, sf), ["country", "pollster"]))


RANKED = """SELECT country, pollster, round(m, 6) AS mean_abs_error, n_polls,
  CAST(row_number() OVER (ORDER BY m, country, pollster) AS BIGINT) AS rank
  FROM (SELECT country, pollster, avg(abs_error) AS m, count(*) AS n_polls FROM errors GROUP BY 1, 2 HAVING count(*) >= 5)"""


@query("WN9", sql("errors", RANKED))
def reliability_rank(spark, sf):
    scores = AG.source_errors(FR.errors(spark, sf), ["country", "pollster"])
    return rounded(WN.global_rank(scores, "mean_abs_error", ["country", "pollster"]))


@query("WN9", sql("errors", RANKED))
def reliability_rank_in_buckets(spark, sf):
    """The same ranking in few buckets."""
    scores = AG.source_errors(FR.errors(spark, sf), ["country", "pollster"])
    return rounded(WN.global_rank(scores, "mean_abs_error", ["country", "pollster"], buckets=8))


@query("TK3", sql("errors", f"""SELECT * FROM (SELECT country, pollster, mean_abs_error, 'lowest' AS "end" FROM ({RANKED}) ORDER BY rank LIMIT 10)
  UNION ALL SELECT * FROM (SELECT country, pollster, mean_abs_error, 'highest' FROM ({RANKED}) ORDER BY mean_abs_error DESC, country, pollster LIMIT 10)"""))
def reliability_extremes(spark, sf):
    scores = AG.source_errors(FR.errors(spark, sf), ["country", "pollster"])
    return rounded(WN.both_ends(scores, "mean_abs_error", 10, ["country", "pollster"]).select("country", "pollster", "mean_abs_error", "end"))


@query("AG15", sql("errors", "SELECT country, pollster, party, round(avg(signed_error), 6) AS house_effect, count(*) AS n_polls FROM errors GROUP BY 1, 2, 3 HAVING count(*) >= 10"))
def house_effect(spark, sf):
    return rounded(AG.house_effects(FR.errors(spark, sf), ["country", "pollster", "party"]))


@query("AG16", sql("polls", """SELECT country, round_even(avg(s), 2) AS mean, round_even(median(s), 2) AS median, round_even(stddev_samp(s), 2) AS std, count(*) AS count
  FROM (SELECT country, stddev_samp(pct) AS s FROM polls GROUP BY country, election_year, party) WHERE s IS NOT NULL GROUP BY country"""))
def volatility(spark, sf):
    return AG.volatility(A.polls(spark, sf), KEYS)


@query("AG17", sql("errors", """SELECT n, round(mu, 6) AS mean_error, round(sd, 6) AS std_error,
  round((s3 / n - 3 * mu * s2 / n + 2 * mu * mu * mu) / pow(vp, 1.5), 4) AS skewness,
  round((s4 / n - 4 * mu * s3 / n + 6 * mu * mu * s2 / n - 3 * mu * mu * mu * mu) / (vp * vp) - 3, 4) AS kurtosis
  FROM (SELECT count(*) AS n, avg(signed_error) AS mu, stddev_samp(signed_error) AS sd, var_pop(signed_error) AS vp,
    sum(signed_error * signed_error) AS s2, sum(pow(signed_error, 3)) AS s3, sum(pow(signed_error, 4)) AS s4 FROM errors)"""))
def error_shape(spark, sf):
    out = AG.error_shape(FR.errors(spark, sf))
    return out.select(
        "n", F.round("mean_error", 6).alias("mean_error"), F.round("std_error", 6).alias("std_error"),
        F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"),
    )


@query("AG18", sql("polls", """, means AS (SELECT country, election_year, poll_date, party, avg(pct) AS v FROM polls GROUP BY 1, 2, 3, 4)
  SELECT a.country, a.election_year, a.party AS series_a, b.party AS series_b, round(CASE WHEN a.party = b.party THEN 1.0 ELSE corr(a.v, b.v) END, 6) AS correlation
  FROM means a JOIN means b ON a.country = b.country AND a.election_year = b.election_year AND a.poll_date = b.poll_date GROUP BY 1, 2, 3, 4""").replace("\n, means", ", means"))
def series_correlation(spark, sf):
    return rounded(AG.series_correlation(A.polls(spark, sf), ["poll_date"], labels=A.PARTIES, by=["country", "election_year"]))


@query("JN13", sql("polls actuals", "SELECT DISTINCT p.party FROM polls p WHERE p.party NOT IN (SELECT party FROM actuals WHERE party <> 'RO')"))
def unmatched_series(spark, sf):
    df = A.polls(spark, sf)
    return JN.unmatched_series(df, JN.many_to_one(df, FR.truth(spark, sf).where("party <> 'RO'"), KEYS))


@query("AG31", sql("errors", """SELECT CAST(least(floor((abs_error - lo) / ((hi - lo) / 24)), 23) AS INTEGER) AS bin, count(*) AS n
  FROM errors, (SELECT min(abs_error) AS lo, max(abs_error) AS hi FROM errors) GROUP BY 1"""))
def histogram_bins(spark, sf):
    return histogram(FR.errors(spark, sf), "abs_error", 24)


BOX = """SELECT country, round(min(abs_error), 6) AS minimum, round(quantile_cont(abs_error, 0.25), 6) AS q1, round(median(abs_error), 6) AS median,
  round(quantile_cont(abs_error, 0.75), 6) AS q3, round(max(abs_error), 6) AS maximum FROM errors GROUP BY country"""


@query("AG31", sql("errors", BOX))
def box_by_country(spark, sf):
    return rounded(box_summary(FR.errors(spark, sf), ["country"], "abs_error"))


@query("AG31", sql("errors", BOX))
def box_by_country_bracketed(spark, sf):
    """The bracketed quantiles used for large inputs, forced here so that the gate covers them."""
    return rounded(box_summary(FR.errors(spark, sf), ["country"], "abs_error"))


@query("AG32", """SELECT 'l_quantity' AS column_name, count(*) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min,
    max(l_quantity) AS max, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75 FROM lineitem
  UNION ALL SELECT 'l_discount', count(*), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), max(l_discount),
    round(quantile_cont(l_discount, 0.25), 6), round(quantile_cont(l_discount, 0.5), 6), round(quantile_cont(l_discount, 0.75), 6) FROM lineitem""")
def numeric_profile(spark, sf):
    return rounded(AG.numeric_profile(A.load(spark, sf, "lineitem"), ["l_quantity", "l_discount"]))


@query("AG33", sql("polls", "SELECT party, count(*) AS n FROM polls GROUP BY party"))
def frequency_counts(spark, sf):
    return AG.frequency(A.polls(spark, sf), "party")


@query("AG34", "SELECT max(value) AS max_value FROM events")
def column_max(spark, sf):
    return AG.column_max(A.load(spark, sf, "events"), "value")


@query("AG35", sql("polls", "SELECT country, count(DISTINCT election_year) AS elections FROM polls GROUP BY country"))
def coverage_counts(spark, sf):
    return AG.coverage(A.polls(spark, sf))


@query("TK5", sql("polls", "SELECT DISTINCT source_table FROM polls ORDER BY 1"))
def option_list(spark, sf):
    return WN.option_list(A.polls(spark, sf), "source_table")


@query("TK2 SC10", sql("errors", f"SELECT country, election_year, party, pollster, {', '.join(ID)}, round(abs_error, 6) AS abs_error FROM errors ORDER BY abs_error DESC, {', '.join(ID)} LIMIT 12"))
def topk_errors(spark, sf):
    return rounded(WN.largest(FR.errors(spark, sf), "abs_error", 12, ID).select(*KEYS, "pollster", *ID, "abs_error"))


@query("PR6", sql("rolling", "SELECT r.country, r.election_year, count(*) AS n FROM rolling r JOIN (SELECT country, election_year, max(poll_date) - INTERVAL 3 MONTH AS lo FROM rolling GROUP BY 1, 2) USING (country, election_year) WHERE poll_date >= lo GROUP BY 1, 2"))
def trailing_three_months(spark, sf):
    from ..plans.marts import trailing_range

    rows = trailing_range(FR.rolling(spark, sf), 3, ["country", "election_year"])
    return rows.groupBy("country", "election_year").agg(F.count("*").alias("n"))


@query("WN1 WN4", """WITH rolled AS (SELECT user_id % 5 AS entity, event_type, event_id, ts,
    avg(value) OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a FROM events)
  SELECT entity, event_type, round(arg_max(a, ROW(ts, event_id)), 6) AS rolling_avg FROM rolled GROUP BY 1, 2""")
def event_series_last_average(spark, sf):
    """The same rolling operator on another series source."""
    rows = A.load(spark, sf, "events").withColumn("entity", F.col("user_id") % 5)
    rolled = rolling_features(rows, ["ts", "event_id"], ["entity", "event_type"], "value")
    return rounded(last_observation(rolled, ["ts", "event_id"], ["rolling_avg"], ["entity", "event_type"]))
