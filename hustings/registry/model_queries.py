"""Registered queries on the modelling table, its checks, and model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as AG
from ..operators import joins as JN
from ..operators import models as M
from ..operators import gates as GT
from ..operators import neighbours as NN
from ..operators import ordering as WN
from ..operators import quality as QC
from ..operators import reshape as RS
from ..plans import dataset as D
from ..session import scratch_path
from ..sizing import settled
from ..sources import adapter as A
from . import frames as FR
from .core import query, rounded
from .fragments import with_fragments as sql

KEYS = ["country", "election_year", "party"]
CYCLE = ["country", "election_year"]


def _round(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


BLOCK = ["final_poll_pct", "final_rolling_avg", "final_momentum_1st", "final_momentum_2nd", "mean_poll_pct", "poll_std",
         "min_poll_pct", "max_poll_pct", "mean_rolling_avg", "mean_momentum_1st", "mean_momentum_2nd"]
RECENT = ["recent_30d_mean", "recent_30d_std", "final_vs_recent_30d_mean"]


@query("AG9 WN4", sql("block", f"SELECT country, election_year, party, dataset_split, election_date, last_poll_date, days_before_election, n_poll_observations, campaign_span_days, {_round(' '.join(BLOCK))} FROM block"))
def feature_block(spark, sf):
    return rounded(FR.dataset(spark, sf).select(
        *KEYS, "dataset_split", "election_date", "last_poll_date", "days_before_election", "n_poll_observations", "campaign_span_days", *BLOCK
    ))


@query("AG10 SC17", sql("block", f"SELECT country, election_year, party, recent_30d_observations, {_round(' '.join(RECENT))} FROM block"))
def recent_window(spark, sf):
    return rounded(FR.dataset(spark, sf).select(*KEYS, "recent_30d_observations", *RECENT))


@query("AG11", sql("block", "SELECT country, election_year, party, round(recent_30d_trend_per_day, 6) AS recent_30d_trend_per_day FROM block"))
def trend_slope(spark, sf):
    return rounded(FR.dataset(spark, sf).select(*KEYS, "recent_30d_trend_per_day"))


@query("AG12 QC2", sql("targets", "SELECT country, election_year, party, round(actual_pct, 6) AS actual_pct, is_winner FROM targets"))
def winner_flag(spark, sf):
    return rounded(D.winner_flags(FR.truth(spark, sf)))


@query("JN3 JN4 AG9", sql("dataset", "SELECT country, election_year, party, dataset_split, n_poll_observations, round(final_rolling_avg, 6) AS final_rolling_avg, round(actual_pct, 6) AS actual_pct, is_winner FROM dataset"))
def model_dataset(spark, sf):
    return rounded(FR.dataset(spark, sf).select(*KEYS, "dataset_split", "n_poll_observations", "final_rolling_avg", "actual_pct", "is_winner"))


@query("JN3 JN11", sql("polls dates splits", "SELECT p.country, p.election_year, dataset_split, count(*) AS n, count(*) FILTER (poll_date > election_date) AS late FROM polls p JOIN dates USING (country, election_year) JOIN splits USING (country, election_year) GROUP BY ALL"))
def dated_features(spark, sf):
    dated = D.dated_features(A.polls(spark, sf), FR.dates(spark, sf), FR.splits(spark, sf))
    return dated.groupBy(*CYCLE, "dataset_split").agg(F.count("*").alias("n"), F.count_if("is_post_election").alias("late"))


@query("AG13", sql("polls dates dataset", """SELECT s.country, s.election_year, source_feature_rows, post_election_rows, dataset_split, model_party_rows, winner_rows, earliest_model_poll, latest_model_poll
  FROM (SELECT country, election_year, count(*) AS source_feature_rows, count(*) FILTER (poll_date > election_date) AS post_election_rows
        FROM polls JOIN dates USING (country, election_year) GROUP BY 1, 2) s
  LEFT JOIN (SELECT country, election_year, dataset_split, count(*) AS model_party_rows, CAST(sum(is_winner) AS BIGINT) AS winner_rows,
        min(last_poll_date) AS earliest_model_poll, max(last_poll_date) AS latest_model_poll FROM dataset GROUP BY 1, 2, 3) d
  ON s.country = d.country AND s.election_year = d.election_year"""))
def model_audit(spark, sf):
    dated = D.dated_features(A.polls(spark, sf), FR.dates(spark, sf), FR.splits(spark, sf))
    return D.model_audit(dated, FR.dataset(spark, sf))


@query("JN5 QC4", sql("dates polls", "SELECT country, election_year FROM dates EXCEPT SELECT country, election_year FROM polls WHERE source_table = 'lot_3' AND party = 'AF' AND poll_date < make_date(election_year, 2, 1)"))
def uncovered_cycles(spark, sf):
    covered = A.polls(spark, sf).where("source_table = 'lot_3' AND party = 'AF' AND poll_date < make_date(election_year, 2, 1)")
    return QC.uncovered(FR.dates(spark, sf), covered)


@query("JN6 GV6", sql("polls actuals", """SELECT DISTINCT country, election_year, party, model_party,
    CASE WHEN model_party IS NULL THEN 'excluded by documented modelling scope' ELSE 'no matching actual-result target' END AS status
  FROM (SELECT *, CASE WHEN country = 'asia' AND party NOT IN ('AF', 'NO') THEN NULL WHEN country = 'europe' AND party = 'RF' THEN 'RX' ELSE party END AS model_party FROM polls)
  WHERE model_party IS NULL OR (country, election_year, model_party) NOT IN (SELECT (country, election_year, party) FROM actuals)"""))
def exclusion_audit(spark, sf):
    from ..functions.scalars import modelled_series

    named = modelled_series(F.col("country"), F.col("party"), {("europe", "RF"): "RX"}, {"asia": ["AF", "NO"]})
    return JN.exclusion_audit(A.polls(spark, sf).withColumn("model_party", named), FR.truth(spark, sf))


@query("JN8", sql("actuals rolling", "SELECT DISTINCT country, election_year FROM actuals WHERE election_year >= 1997 INTERSECT SELECT country, election_year FROM rolling"))
def modelled_cycles(spark, sf):
    return D.modelled_cycles(FR.truth(spark, sf).where("election_year >= 1997"), FR.rolling(spark, sf))


@query("JN9", sql("dataset", """SELECT country, election_year, count(*) AS test_rows, CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS train_rows,
  count(*) OVER () - 1 AS train_cycles FROM dataset WHERE dataset_split = 'development' GROUP BY 1, 2"""))
def fold_train_sizes(spark, sf):
    return JN.fold_training_sizes(FR.settled_dataset(spark, sf).where("dataset_split = 'development'"))


@query("GV7", sql("splits", "SELECT * FROM splits"))
def split_table(spark, sf):
    """Split lists stored with years as ``1995.0`` read back into one checked table."""
    stored = FR.splits(spark, sf).withColumn("election_year", F.col("election_year").cast("double").cast("string"))
    parts = [stored.where(F.col("dataset_split") == s).drop("dataset_split") for s in ("development", "holdout")]
    return D.split_table(*parts)


# ---- winners, scores -------------------------------------------------------------------------------------------

@query("WN5 ML8", sql("calls", "SELECT country, election_year, actual_winner, predicted_winner, winner_correct FROM calls"))
def predicted_leader(spark, sf):
    return M.winner_calls(FR.settled_dataset(spark, sf), "final_rolling_avg")


@query("ML8", sql("calls", "SELECT round(avg(winner_correct), 6) AS value FROM calls"))
def winner_accuracy(spark, sf):
    return rounded(M.winner_accuracy(M.winner_calls(FR.settled_dataset(spark, sf), "final_rolling_avg")))


@query("WN7", sql("actuals", """SELECT country, election_year, max(party) FILTER (rn = 1) AS leader, round(max(actual_pct) FILTER (rn = 1), 6) AS leader_value,
  round(max(actual_pct) FILTER (rn = 2), 6) AS runner_up_value, round(max(actual_pct) FILTER (rn = 1) - max(actual_pct) FILTER (rn = 2), 6) AS margin
  FROM (SELECT *, row_number() OVER (PARTITION BY country, election_year ORDER BY actual_pct DESC, party) AS rn FROM actuals) GROUP BY 1, 2"""))
def top2_margin(spark, sf):
    return rounded(WN.top_two_margin(FR.truth(spark, sf), CYCLE, "actual_pct", "party"))


@query("ML1 ML7", sql("dataset", "SELECT dataset_split, round(avg(abs(final_rolling_avg - actual_pct)), 6) AS \"MAE\", round(sqrt(avg(pow(final_rolling_avg - actual_pct, 2))), 6) AS \"RMSE\" FROM dataset GROUP BY 1"))
def mae_rmse(spark, sf):
    return rounded(M.regression_metrics(FR.dataset(spark, sf), "actual_pct", "final_rolling_avg", ["dataset_split"]))


AUC = """SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS value FROM (
  SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT final_rolling_avg AS score, sum(is_winner) AS pos, sum(1 - is_winner) AS neg FROM dataset GROUP BY 1))"""


@query("ML9", sql("dataset", AUC))
def auc_rank(spark, sf):
    return rounded(M.roc_auc(FR.dataset(spark, sf), "is_winner", "final_rolling_avg"))


@query("ML9", """WITH s AS (SELECT l_quantity AS score, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS pos, CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) AS neg FROM lineitem GROUP BY 1)
  SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS value FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)""")
def auc_rank_in_buckets(spark, sf):
    """The rank statistic over all line items."""
    rows = A.load(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), "l_quantity")
    return rounded(M.roc_auc(rows, "label", "l_quantity"))


@query("ML10", sql("dataset", "SELECT round(avg(CAST((final_rolling_avg / 100 >= 0.5) = (is_winner = 1) AS INTEGER)), 6) AS value FROM dataset"))
def row_accuracy(spark, sf):
    df = FR.dataset(spark, sf).withColumn("p", F.col("final_rolling_avg") / 100)
    return rounded(M.row_accuracy(df, "is_winner", "p"))


@query("ML11 SC19", sql("dataset calls", """SELECT task, model, metric, round(value, 6) AS value,
    round(CASE WHEN metric = 'election_winner_accuracy' THEN value * 100 ELSE value END, 6) AS display_value FROM (
  SELECT 'vote_share_regression' AS task, 'final_polling_average' AS model, 'MAE' AS metric, avg(abs(final_rolling_avg - actual_pct)) AS value FROM dataset
  UNION ALL SELECT 'vote_share_regression', 'final_polling_average', 'RMSE', sqrt(avg(pow(final_rolling_avg - actual_pct, 2))) FROM dataset
  UNION ALL SELECT 'winner_classification', 'final_polling_average', 'election_winner_accuracy', avg(winner_correct) FROM calls)"""))
def metrics_long(spark, sf):
    return rounded(_metrics(spark, sf))


def _metrics(spark, sf):
    from ..functions.scalars import display_value

    df = FR.settled_dataset(spark, sf)
    scores = M.regression_metrics(df, "actual_pct", "final_rolling_avg")
    parts = [("vote_share_regression", "final_polling_average", m, scores.select(F.col(m).alias("value"))) for m in ("MAE", "RMSE")]
    accuracy = M.winner_accuracy(M.winner_calls(df, "final_rolling_avg"))
    parts.append(("winner_classification", "final_polling_average", "election_winner_accuracy", accuracy))
    return M.metric_rows(parts).withColumn("display_value", display_value(F.col("metric"), F.col("value")))


@query("SC20", sql("dataset", "SELECT round(avg(abs(final_rolling_avg - actual_pct)), 6) AS value FROM dataset"))
def metric_lookup(spark, sf):
    from ..functions.scalars import metric_lookup as look

    return rounded(look(_metrics(spark, sf), "mae"))


@query("RS2", sql("dataset", """SELECT model, row_order, round("MAE", 6) AS "MAE", round("RMSE", 6) AS "RMSE" FROM (
    SELECT 'final_polling_average' AS model, 1 AS row_order, avg(abs(final_rolling_avg - actual_pct)) AS "MAE", sqrt(avg(pow(final_rolling_avg - actual_pct, 2))) AS "RMSE" FROM dataset
    UNION ALL SELECT 'absent_model', 0, NULL, NULL)"""))
def pivot_matrix(spark, sf):
    metrics = _metrics(spark, sf)
    return rounded(RS.fixed_matrix(metrics, "model", ["absent_model", "final_polling_average"], "metric", ["MAE", "RMSE"], "value"))


@query("RS4", sql("dataset", "SELECT model, round(avg(abs(final_rolling_avg - actual_pct)), 6) AS \"MAE\", round(sqrt(avg(pow(final_rolling_avg - actual_pct, 2))), 6) AS \"RMSE\" FROM (SELECT *, 'final_polling_average' AS model FROM dataset) GROUP BY model"))
def metric_matrix(spark, sf):
    metrics = _metrics(spark, sf).where("task = 'vote_share_regression'")
    return rounded(RS.metric_matrix(metrics, ["model"], ["MAE", "RMSE"]))


@query("ML12", sql("calls", f"""SELECT country, election_year, actual_winner, predicted_winner, winner_correct,
  {_round('predicted_winner_polling_pct predicted_winner_actual_pct predicted_margin actual_margin')} FROM calls WHERE dataset_split = 'holdout'"""))
def holdout_results(spark, sf):
    held = FR.holdout(FR.settled_dataset(spark, sf))
    return rounded(M.election_results(held, "selected_vote_prediction"))


@query("ML12 SC10", sql("oof", f"SELECT country, election_year, party, is_winner, called AS selected_model_predicted_winner, round(actual_pct, 6) AS actual_pct, round(baseline_vote_prediction, 6) AS selected_vote_prediction, round(baseline_error, 6) AS vote_share_error, round(baseline_abs_error, 6) AS absolute_error FROM oof WHERE dataset_split = 'holdout'"))
def holdout_predictions(spark, sf):
    return rounded(FR.holdout(FR.dataset(spark, sf)).select(
        *KEYS, "is_winner", "selected_model_predicted_winner", "actual_pct", "selected_vote_prediction", "vote_share_error", "absolute_error"
    ))


@query("AG20 ML12", sql("oof", "SELECT country, count(*) AS rows, count(DISTINCT election_year) AS elections, round(avg(baseline_abs_error), 6) AS mae, round(avg(baseline_error), 6) AS mean_error, round(sqrt(avg(baseline_error * baseline_error)), 6) AS rmse FROM oof WHERE dataset_split = 'holdout' GROUP BY country"))
def holdout_country_errors(spark, sf):
    return rounded(AG.signed_error_summary(FR.holdout(FR.dataset(spark, sf)), ["country"], "vote_share_error", "absolute_error"))


@query("AG19", sql("oof", f"SELECT country, count(*) AS rows, count(DISTINCT election_year) AS elections, round(avg(baseline_abs_error), 6) AS baseline_mae, round(avg(baseline_error), 6) AS baseline_mean_error, round(avg(ridge_abs_error), 6) AS ridge_mae, round(avg(ridge_error), 6) AS ridge_mean_error FROM oof WHERE dataset_split = 'development' GROUP BY country"))
def country_error_summary(spark, sf):
    return rounded(AG.two_model_error_summary(FR.development(FR.dataset(spark, sf)), ["country"]))


@query("ML14", sql("calls oof", """SELECT c.country, c.election_year, party_rows, round(election_mae, 6) AS election_baseline_mae, round(challenger_mae, 6) AS election_ridge_mae,
    actual_winner, predicted_winner AS polling_winner, winner_correct, round(actual_margin, 6) AS actual_margin, round(predicted_margin, 6) AS polling_margin,
    round(w.actual_pct, 6) AS actual_winner_pct, round(w.baseline_vote_prediction, 6) AS actual_winner_polling_average, round(w.baseline_error, 6) AS actual_winner_poll_error
  FROM calls c JOIN oof w ON w.country = c.country AND w.election_year = c.election_year AND w.is_winner = 1 WHERE c.dataset_split = 'development'"""))
def election_errors(spark, sf):
    return rounded(M.election_error_summary(FR.development(FR.settled_dataset(spark, sf))))


@query("ML13", sql("oof", """SELECT a.country, a.election_year, a.party AS actual_winner, round(a.actual_pct, 6) AS actual_winner_actual_pct,
    round(a.baseline_vote_prediction, 6) AS actual_winner_polling_pct, round(a.baseline_error, 6) AS actual_winner_poll_error,
    p.party AS polling_winner, round(p.actual_pct, 6) AS polling_winner_actual_pct, round(p.baseline_vote_prediction, 6) AS polling_winner_polling_pct,
    round(p.baseline_error, 6) AS polling_winner_poll_error, round(p.baseline_vote_prediction - a.baseline_vote_prediction, 6) AS polling_lead_over_actual_winner,
    round(a.actual_pct - p.actual_pct, 6) AS actual_lead_over_polling_winner
  FROM oof a JOIN oof p ON a.country = p.country AND a.election_year = p.election_year AND a.is_winner = 1 AND p.called = 1 AND a.party <> p.party
  WHERE a.dataset_split = 'development'"""))
def wrong_winner(spark, sf):
    return rounded(M.wrong_winners(FR.development(FR.settled_dataset(spark, sf))))


# ---- fitted models: no SQL equivalent, checked against numpy in the tests ---------------------------------------

def _development(spark, sf):
    """All development rows. Without an observation in the recent window, its mean is the final average and the rest is 0."""
    df = FR.settled_dataset(spark, sf).where("dataset_split = 'development'")
    zero = ["recent_30d_std", "recent_30d_observations", "recent_30d_trend_per_day", "final_vs_recent_30d_mean"]
    return df.withColumns({"recent_30d_mean": F.coalesce("recent_30d_mean", "final_rolling_avg"), **{c: F.coalesce(c, F.lit(0)) for c in zero}})


@query("ML2 ML3 ML4")
def loeo_ridge(spark, sf):
    out = M.ridge_predictions(_development(spark, sf), M.FEATURE_SETS["legacy_broad"])
    return rounded(out.select(*KEYS, "actual_pct", "ridge_vote_prediction"))


ONE = """, d AS (SELECT country, election_year, party, final_rolling_avg AS x, actual_pct AS y FROM dataset WHERE dataset_split = 'development'),
  own AS (SELECT country, election_year, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d GROUP BY 1, 2),
  other AS (SELECT country, election_year, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy,
    sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy FROM own),
  fit AS (SELECT *, sqrt(sxx / n - pow(sx / n, 2)) AS s FROM other),
  slope AS (SELECT *, ((sxy - sx * sy / n) / s) / (n + 10) / s AS b FROM fit)
  SELECT d.country, d.election_year, party, round(sy / n + b * (x - sx / n), 6) AS ridge_vote_prediction FROM d JOIN slope USING (country, election_year)"""


@query("ML2 ML4", sql("dataset", ONE))
def loeo_ridge_one_feature(spark, sf):
    """The same operator on one feature and one entity, where the fit has a closed form."""
    df = _development(spark, sf).withColumn("everywhere", F.lit("all"))
    out = M.ridge_predictions(df, ["final_rolling_avg"], entity="everywhere")
    return rounded(out.select(*KEYS, "ridge_vote_prediction"))


@query("ML2 ML5")
def loeo_logistic(spark, sf):
    out = M.logistic_predictions(_development(spark, sf), M.FEATURE_SETS["legacy_broad"])
    return rounded(out.select(*KEYS, "is_winner", "logistic_win_probability"), 4)


@query("ML6 ML2 ML7 ML8 ML9 ML10 ML11")
def feature_ablation(spark, sf):
    """Every score of benchmark, ridge and logistic for each feature set, over out-of-fold predictions of all rows."""
    base = _development(spark, sf)
    parts = [M.evaluation_metrics(settled(M.out_of_fold(base, features)), {"feature_set": name}) for name, features in M.FEATURE_SETS.items()]
    return rounded(RS.union_all(*parts), 5)


# ---- similar cycles --------------------------------------------------------------------------------------------

@query("ML16 WN7", sql("vectors", f"SELECT country, election_year, leader_party, n_polls, {_round('final_leader_pct poll_volatility actual_margin')} FROM vectors"))
def election_vectors(spark, sf):
    return rounded(NN.election_vectors(FR.rolling(spark, sf), FR.truth(spark, sf), A.ORDER))


NEAR = """, z AS (SELECT country, election_year,
    (final_leader_pct - avg(final_leader_pct) OVER ()) / nullif(stddev_pop(final_leader_pct) OVER (), 0) AS a,
    (poll_volatility - avg(poll_volatility) OVER ()) / nullif(stddev_pop(poll_volatility) OVER (), 0) AS b,
    (actual_margin - avg(actual_margin) OVER ()) / nullif(stddev_pop(actual_margin) OVER (), 0) AS c,
    (n_polls - avg(n_polls) OVER ()) / nullif(stddev_pop(n_polls) OVER (), 0) AS d FROM vectors)
  SELECT country, election_year, similar_country, similar_election_year, round(distance, 6) AS distance FROM (
    SELECT x.country, x.election_year, y.country AS similar_country, y.election_year AS similar_election_year,
      sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) + pow(x.d - y.d, 2)) AS distance,
      row_number() OVER (PARTITION BY x.country, x.election_year ORDER BY
        sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) + pow(x.d - y.d, 2)), y.country, y.election_year) AS rn
    FROM z x JOIN z y ON (x.country, x.election_year) <> (y.country, y.election_year)) WHERE rn <= 3"""


@query("ML15 JN12", sql("vectors", NEAR))
def knn_similar(spark, sf):
    vectors = settled(NN.election_vectors(FR.rolling(spark, sf), FR.truth(spark, sf), A.ORDER))
    return rounded(NN.nearest_neighbours(vectors, CYCLE, k=3))


@query("ML15 JN12", sql("vectors", NEAR))
def knn_similar_by_grid(spark, sf):
    """The same search over boxes of two points, so that the gate covers many boxes and rounds of visits."""
    vectors = settled(NN.election_vectors(FR.rolling(spark, sf), FR.truth(spark, sf), A.ORDER))
    return rounded(NN.nearest_neighbours(vectors, CYCLE, k=3, box_points=2))


# ---- quality ---------------------------------------------------------------------------------------------------

@query("QC1", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicates(spark, sf):
    return QC.duplicate_keys(A.load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("QC2", sql("targets", "SELECT country, election_year, CAST(sum(is_winner) AS BIGINT) AS winners FROM targets WHERE party <> 'AF' GROUP BY 1, 2 HAVING sum(is_winner) <> 1"))
def dq_winners(spark, sf):
    return QC.wrong_winner_counts(D.winner_flags(FR.truth(spark, sf)).where("party <> 'AF'"))


@query("QC3", sql("polls dates", "SELECT country, election_year, count(*) AS n FROM polls JOIN dates USING (country, election_year) WHERE poll_date > election_date GROUP BY 1, 2"))
def dq_after_cutoff(spark, sf):
    dated = JN.many_to_one(A.polls(spark, sf), FR.dates(spark, sf), CYCLE)
    return QC.after_cutoff(dated, "poll_date").groupBy(*CYCLE).agg(F.count("*").alias("n"))


@query("QC5", """SELECT 'value' AS column_name, count(*) FILTER (event_id % 7 = 0) AS missing, count(*) FILTER (event_id % 7 = 1) AS infinite FROM events
  UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL), 0 FROM events""")
def dq_numbers(spark, sf):
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return QC.invalid_numbers(A.load(spark, sf, "events").withColumn("value", value), ["value", "user_id"])


@query("QC6", sql("splits", "SELECT * FROM splits WHERE dataset_split <> 'development'"))
def dq_split_purity(spark, sf):
    return QC.outside_split(FR.splits(spark, sf), "development")


@query("QC7", sql("dates", "SELECT 'rows' AS figure, count(*) AS found, CAST(22 AS BIGINT) AS expected FROM dates UNION ALL SELECT 'entities', count(DISTINCT country), 4 FROM dates"))
def dq_totals(spark, sf):
    return QC.expected_totals(FR.dates(spark, sf), {"rows": 22, "entities": 4})


@query("QC8", sql("errors", "SELECT round(max(abs(abs(signed_error) - abs_error)), 6) AS max_gap FROM errors"))
def dq_error_consistency(spark, sf):
    return rounded(QC.error_consistency(FR.errors(spark, sf), "signed_error", "abs_error"))


@query("QC1 QC2 QC3 QC4 QC5 QC7", sql("dataset splits", """SELECT figure, CAST(value AS BIGINT) AS value FROM (
  SELECT UNNEST([{'figure': 'rows', 'value': count(*)}, {'figure': 'cycles', 'value': count(DISTINCT (country, election_year))},
    {'figure': 'repeated keys', 'value': count(*) - count(DISTINCT (country, election_year, party))},
    {'figure': 'cycles without one winner', 'value': (SELECT count(*) FROM (SELECT 1 FROM dataset GROUP BY country, election_year HAVING sum(is_winner) <> 1))},
    {'figure': 'past the cutoff', 'value': count(*) FILTER (last_poll_date > election_date)},
    {'figure': 'covered cycles', 'value': (SELECT count(*) FROM splits s WHERE EXISTS (SELECT 1 FROM dataset d WHERE d.country = s.country AND d.election_year = s.election_year))},
    {'figure': 'missing recent_30d_mean', 'value': count(*) FILTER (recent_30d_mean IS NULL)}, {'figure': 'infinite recent_30d_mean', 'value': 0},
    {'figure': 'missing poll_std', 'value': count(*) FILTER (poll_std IS NULL)}, {'figure': 'infinite poll_std', 'value': 0}], recursive := true) FROM dataset)"""))
def stored_dataset_figures(spark, sf):
    """The modelling table stored with all its gates in one job; the figures were counted while it was written."""
    c = FR.campaign(spark, sf)
    figures = GT.store_dataset(FR.campaign_dataset(c), c.splits, scratch_path(spark, "dataset"), ["recent_30d_mean", "poll_std"])
    return spark.createDataFrame(list(figures.items()), "figure string, value long")
