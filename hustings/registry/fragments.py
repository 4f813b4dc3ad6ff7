"""Shared SQL for the oracles: named table expressions and what each needs."""

from __future__ import annotations

TIE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
ORDER = "poll_date, " + TIE

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "polls": (
        (),
        f"""
        SELECT lower(r_name) AS country, CAST(year(l_shipdate) AS INTEGER) AS election_year,
               l_returnflag || l_linestatus AS party, CAST(l_shipdate AS DATE) AS poll_date,
               l_quantity * 2.0 AS pct, s_name AS pollster,
               'lot_' || CAST(l_partkey % 20 AS VARCHAR) AS source_table,
               CASE l_orderkey % 6
                 WHEN 0 THEN strftime(l_shipdate, '%-m/%-d/%Y')
                 WHEN 1 THEN strftime(l_shipdate, '%B %-d, %Y')
                 WHEN 2 THEN strftime(l_shipdate, '%-d %b %Y')
                 WHEN 3 THEN CAST(greatest(day(l_shipdate) - 1, 1) AS VARCHAR) || '-' || strftime(l_shipdate, '%-d %b %Y')
                 WHEN 4 THEN CAST(greatest(day(l_shipdate) - 1, 1) AS VARCHAR) || '–' || strftime(l_shipdate, '%-d %b')
                 ELSE strftime(l_shipdate, '%-d %b') END AS date_raw,
               {TIE}
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "marked": (
        ("polls",),
        f"""
        SELECT country, election_year, party, poll_date, source_table,
               CASE WHEN l_orderkey % 200 IN (7, 47, 87, 127, 167) THEN 16.5 + (l_partkey % 20) * 0.4 ELSE pct END AS pct,
               CASE l_orderkey % 200 WHEN 127 THEN CAST(election_year AS VARCHAR) || ' general election'
                 WHEN 167 THEN CAST(election_year - 4 AS VARCHAR) || ' general election' ELSE pollster END AS pollster,
               CASE l_orderkey % 200 WHEN 7 THEN 'Voting results' WHEN 47 THEN 'Election [3]'
                 WHEN 87 THEN date_raw || ' election' ELSE date_raw END AS date_raw,
               {TIE}
        FROM polls""",
    ),
    "dates": (
        ("polls",),
        "SELECT DISTINCT country, election_year, make_date(election_year, 11, 1) AS election_date FROM polls",
    ),
    "actuals": (
        ("polls",),
        """
        SELECT country, election_year, party,
               100.0 * sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (PARTITION BY country, election_year) AS actual_pct
        FROM polls GROUP BY country, election_year, party""",
    ),
    "retained": (
        ("polls", "dates"),
        "SELECT p.*, election_date FROM polls p LEFT JOIN dates USING (country, election_year) WHERE NOT coalesce(poll_date > election_date, false)",
    ),
    "removed": (
        ("polls", "dates"),
        "SELECT p.*, election_date FROM polls p LEFT JOIN dates USING (country, election_year) WHERE poll_date > election_date",
    ),
    "rolling": (
        ("retained",),
        f"""
        SELECT *, avg(pct) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_avg,
               pct - lag(pct) OVER w AS momentum_1st_diff,
               (pct - lag(pct) OVER w) - (lag(pct) OVER w - lag(pct, 2) OVER w) AS momentum_2nd_diff
        FROM retained WINDOW w AS (PARTITION BY country, election_year, party ORDER BY {ORDER})""",
    ),
    "splits": (
        ("dates",),
        """
        SELECT country, election_year,
               CASE WHEN row_number() OVER (PARTITION BY country ORDER BY election_year DESC)
                         <= least(2, count(*) OVER (PARTITION BY country) - 1) THEN 'holdout' ELSE 'development' END AS dataset_split
        FROM dates""",
    ),
    "last_rows": (
        ("rolling",),
        f"""
        SELECT country, election_year, party, poll_date AS last_poll_date, pct AS final_poll_pct,
               rolling_avg AS final_rolling_avg, momentum_1st_diff AS m1, momentum_2nd_diff AS m2
        FROM (SELECT *, row_number() OVER (PARTITION BY country, election_year, party ORDER BY
              poll_date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn
              FROM rolling) WHERE rn = 1""",
    ),
    "block": (
        ("rolling", "splits", "last_rows"),
        """
        SELECT r.country, r.election_year, r.party, r.election_date, s.dataset_split, any_value(l.last_poll_date) AS last_poll_date,
               CAST(r.election_date - any_value(l.last_poll_date) AS INTEGER) AS days_before_election,
               any_value(l.final_poll_pct) AS final_poll_pct, any_value(l.final_rolling_avg) AS final_rolling_avg,
               coalesce(any_value(l.m1), 0.0) AS final_momentum_1st, coalesce(any_value(l.m2), 0.0) AS final_momentum_2nd,
               avg(pct) FILTER (in_window) AS recent_30d_mean, stddev_pop(pct) FILTER (in_window) AS recent_30d_std,
               count(pct) FILTER (in_window) AS recent_30d_observations,
               CASE WHEN min(poll_date) FILTER (in_window) < max(poll_date) FILTER (in_window)
                    THEN regr_slope(pct, CAST(poll_date - r.election_date AS DOUBLE)) FILTER (in_window) ELSE 0.0 END AS recent_30d_trend_per_day,
               any_value(l.final_rolling_avg) - avg(pct) FILTER (in_window) AS final_vs_recent_30d_mean,
               avg(pct) AS mean_poll_pct, stddev_pop(pct) AS poll_std, min(pct) AS min_poll_pct, max(pct) AS max_poll_pct,
               avg(rolling_avg) AS mean_rolling_avg, coalesce(avg(momentum_1st_diff), 0.0) AS mean_momentum_1st,
               coalesce(avg(momentum_2nd_diff), 0.0) AS mean_momentum_2nd, count(*) AS n_poll_observations,
               CAST(max(poll_date) - min(poll_date) AS INTEGER) AS campaign_span_days
        FROM (SELECT *, poll_date BETWEEN election_date - 30 AND election_date AS in_window FROM rolling) r
        JOIN splits s ON r.country = s.country AND r.election_year = s.election_year
        JOIN last_rows l ON r.country = l.country AND r.election_year = l.election_year AND r.party = l.party
        GROUP BY r.country, r.election_year, r.party, r.election_date, s.dataset_split""",
    ),
    "targets": (
        ("actuals",),
        """
        SELECT *, CAST(actual_pct = max(actual_pct) OVER (PARTITION BY country, election_year) AS INTEGER) AS is_winner
        FROM actuals""",
    ),
    "dataset": (("block", "targets"), "SELECT * FROM block JOIN targets USING (country, election_year, party)"),
    # Out-of-fold stand-in: the benchmark against a challenger that predicts the mean reading.
    "oof": (
        ("dataset",),
        """
        SELECT *, final_rolling_avg AS baseline_vote_prediction, mean_poll_pct AS ridge_vote_prediction,
               final_rolling_avg - actual_pct AS baseline_error, abs(final_rolling_avg - actual_pct) AS baseline_abs_error,
               mean_poll_pct - actual_pct AS ridge_error, abs(mean_poll_pct - actual_pct) AS ridge_abs_error,
               CAST(row_number() OVER (PARTITION BY country, election_year ORDER BY final_rolling_avg DESC, party) = 1 AS INTEGER) AS called,
               row_number() OVER (PARTITION BY country, election_year ORDER BY final_rolling_avg DESC, party) AS polled_place,
               row_number() OVER (PARTITION BY country, election_year ORDER BY actual_pct DESC, party) AS actual_place
        FROM dataset""",
    ),
    "calls": (
        ("oof",),
        """
        SELECT country, election_year, dataset_split,
               max(party) FILTER (is_winner = 1) AS actual_winner, max(party) FILTER (called = 1) AS predicted_winner,
               CAST(max(party) FILTER (is_winner = 1) = max(party) FILTER (called = 1) AS INTEGER) AS winner_correct,
               max(final_rolling_avg) FILTER (called = 1) AS predicted_winner_polling_pct,
               max(actual_pct) FILTER (called = 1) AS predicted_winner_actual_pct,
               max(final_rolling_avg) FILTER (polled_place = 1) - max(final_rolling_avg) FILTER (polled_place = 2) AS predicted_margin,
               max(actual_pct) FILTER (actual_place = 1) - max(actual_pct) FILTER (actual_place = 2) AS actual_margin,
               count(*) AS party_rows, avg(baseline_abs_error) AS election_mae, avg(ridge_abs_error) AS challenger_mae
        FROM oof GROUP BY country, election_year, dataset_split""",
    ),
    "metadata": (
        (),
        """
        SELECT * FROM (VALUES ('africa', 'Africa', 'AFR'), ('america', 'America', 'AME'), ('asia', 'Asia', 'ASI'),
               ('europe', 'Europe', 'EUR'), ('middle east', 'Middle East', 'MEA')) v(country, country_label, iso_alpha)""",
    ),
    "errors": (
        ("polls", "actuals"),
        """
        SELECT p.*, actual_pct, pct - actual_pct AS signed_error, abs(pct - actual_pct) AS abs_error
        FROM polls p JOIN actuals USING (country, election_year, party)""",
    ),
    "marker_rows": (
        ("marked",),
        """
        SELECT *, coalesce(date_raw, '') || ' | ' || coalesce(pollster, '') AS marker_text,
               CASE WHEN len(yrs) > 0 AND NOT list_contains(yrs, CAST(election_year AS VARCHAR)) THEN 'historical_other_year'
                    WHEN len(yrs) > 0 THEN 'explicit_current_year' ELSE 'generic_current_candidate' END AS marker_relevance
        FROM (SELECT *, regexp_extract_all(coalesce(date_raw, '') || ' | ' || coalesce(pollster, ''), '\\b(?:19|20)\\d{2}\\b') AS yrs
              FROM marked WHERE date_raw IN ('Voting results', 'Election [3]') OR pollster LIKE '% general election')""",
    ),
    "candidates": (
        ("marker_rows", "actuals"),
        """
        SELECT v.country, v.election_year, source_table, date_raw, marker_relevance,
               array_to_string(list_sort(list_distinct(flatten(list(texts)))), ' | ') AS marker_text,
               count(*) AS marker_party_rows, count(actual_pct) AS national_overlap_parties,
               avg(abs(pct - actual_pct)) AS marker_mae, max(abs(pct - actual_pct)) AS marker_max_abs_error,
               array_to_string(list_sort(list(party) FILTER (actual_pct IS NOT NULL)), '|') AS matched_parties
        FROM (SELECT country, election_year, source_table, date_raw, marker_relevance, party, avg(pct) AS pct,
                     list(DISTINCT marker_text) AS texts
              FROM marker_rows GROUP BY country, election_year, source_table, date_raw, marker_relevance, party) v
        LEFT JOIN actuals USING (country, election_year, party)
        GROUP BY v.country, v.election_year, source_table, date_raw, marker_relevance""",
    ),
    "best": (
        ("candidates",),
        """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, election_year, source_table
          ORDER BY national_overlap_parties DESC, marker_mae ASC NULLS LAST, date_raw ASC NULLS LAST, marker_relevance) AS rn
          FROM candidates WHERE marker_relevance <> 'historical_other_year') WHERE rn = 1""",
    ),
    "audit": (
        ("marked", "candidates", "best"),
        """
        SELECT l.country, l.election_year, l.source_table, poll_party_rows, party_count, party_signature,
               coalesce(n, 0) AS marker_candidate_count, coalesce(date_raw, '') AS best_marker_date_raw,
               coalesce(marker_relevance, '') AS best_marker_relevance,
               coalesce(national_overlap_parties, 0) AS national_overlap_parties, marker_mae, marker_max_abs_error,
               CASE WHEN marker_relevance IS NULL OR national_overlap_parties < 2 OR marker_mae IS NULL THEN 'review'
                    WHEN marker_mae <= 1.5 AND marker_max_abs_error <= 3 THEN 'approved_marker_match'
                    WHEN marker_mae >= 3 OR marker_max_abs_error >= 6 THEN 'rejected_marker_mismatch' ELSE 'review' END AS scope_status,
               CASE WHEN marker_relevance IS NULL THEN 'no usable current-cycle election marker'
                    WHEN national_overlap_parties < 2 OR marker_mae IS NULL THEN 'fewer than 2 marker parties matched national actuals'
                    WHEN marker_mae <= 1.5 AND marker_max_abs_error <= 3 THEN 'election marker closely matches national actual results'
                    WHEN marker_mae >= 3 OR marker_max_abs_error >= 6 THEN 'election marker materially differs from national actual results'
                    ELSE 'marker comparison is inconclusive' END AS scope_reason
        FROM (SELECT country, election_year, source_table, count(*) AS poll_party_rows, count(DISTINCT party) AS party_count,
                     array_to_string(list_sort(list(DISTINCT party)), '|') AS party_signature
              FROM marked GROUP BY country, election_year, source_table) l
        LEFT JOIN (SELECT country, election_year, source_table, count(*) AS n FROM candidates GROUP BY 1, 2, 3) c
          ON l.country = c.country AND l.election_year = c.election_year AND l.source_table = c.source_table
        LEFT JOIN best b ON l.country = b.country AND l.election_year = b.election_year AND l.source_table = b.source_table""",
    ),
    "decided": (
        ("marked", "audit"),
        """
        SELECT m.*, scope_status, override_status, evidence,
               coalesce(override_status, scope_status, 'unclassified') AS effective_scope_status,
               coalesce(reason, scope_reason, 'source table was absent from the scope audit') AS effective_scope_reason
        FROM marked m LEFT JOIN (SELECT * FROM audit WHERE source_table <> 'lot_19') a USING (country, election_year, source_table)
        LEFT JOIN (SELECT DISTINCT country, election_year, source_table,
              CASE source_table WHEN 'lot_5' THEN 'manual_approved' ELSE 'manual_rejected' END AS override_status,
              CASE source_table WHEN 'lot_5' THEN 'reviewed by hand' ELSE 'regional coverage' END AS reason,
              'adapter rule' AS evidence
            FROM marked WHERE source_table IN ('lot_5', 'lot_1')) o USING (country, election_year, source_table)""",
    ),
    "vectors": (
        ("rolling", "last_rows", "targets"),
        """
        SELECT t.country, t.election_year, t.party AS leader_party, any_value(l.final_rolling_avg) AS final_leader_pct,
               coalesce(stddev_samp(r.pct), 0.0) AS poll_volatility, any_value(margin) AS actual_margin, count(*) AS n_polls
        FROM (SELECT country, election_year, max(party) FILTER (rn = 1) AS party,
                     max(actual_pct) FILTER (rn = 1) - max(actual_pct) FILTER (rn = 2) AS margin
              FROM (SELECT *, row_number() OVER (PARTITION BY country, election_year ORDER BY actual_pct DESC, party) AS rn FROM targets)
              GROUP BY country, election_year) t
        JOIN rolling r ON r.country = t.country AND r.election_year = t.election_year AND r.party = t.party
        JOIN last_rows l ON l.country = t.country AND l.election_year = t.election_year AND l.party = t.party
        WHERE margin IS NOT NULL GROUP BY t.country, t.election_year, t.party""",
    ),
}


def with_fragments(names: str, body: str) -> str:
    """``WITH`` clause holding the named fragments and everything they need, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in FRAGMENTS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({FRAGMENTS[n][1]})" for n in ordered)
    return f"WITH {ctes}\n{body}"
