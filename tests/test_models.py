import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from hustings.operators import models as M

FEATURES = ["f1", "f2", "const"]


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(7)
    data = []
    for c in ("aa", "bb", "cc"):
        for year in range(2000, 2004 if c != "cc" else 2001):  # cc is unseen in training when held out
            for i, p in enumerate("xyz"):
                f1, f2 = rnd.uniform(10, 50), rnd.uniform(0, 3)
                data.append((c, year, p, f1, f2, 4.0, f1 * 0.8 + f2 + rnd.gauss(0, 2), int(i == rnd.randrange(3))))
    return spark.createDataFrame(data, "country string, election_year int, party string, f1 double, f2 double, const double, actual_pct double, is_winner int")


def design(train, test):
    x, t = train[FEATURES].to_numpy(float), test[FEATURES].to_numpy(float)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    cats = sorted(set(train["country"]))
    hot = lambda d: np.array([[float(c == k) for k in cats] for c in d["country"]])
    return np.hstack([(x - mean) / sd, hot(train)]), np.hstack([(t - mean) / sd, hot(test)])


def folds(pdf):
    for (c, y), test in pdf.groupby(["country", "election_year"]):
        yield pdf[~((pdf.country == c) & (pdf.election_year == y))], test


def test_ridge_matches_refits(table):
    pdf = table.toPandas()
    got = M.ridge_predictions(table, FEATURES).toPandas().set_index(["country", "election_year", "party"])["ridge_vote_prediction"]
    for train, test in folds(pdf):
        x, t = design(train, test)
        y = train["actual_pct"].to_numpy()
        xc = x - x.mean(axis=0)
        w = np.linalg.solve(xc.T @ xc + 10 * np.eye(x.shape[1]), xc.T @ (y - y.mean()))
        for row, want in zip(test.itertuples(), (t - x.mean(axis=0)) @ w + y.mean()):
            assert abs(got[(row.country, row.election_year, row.party)] - want) < 1e-8


def test_logistic_matches_newton(table):
    pdf = table.toPandas()
    got = M.logistic_predictions(table, FEATURES).toPandas().set_index(["country", "election_year", "party"])["logistic_win_probability"]
    for train, test in folds(pdf):
        x, t = design(train, test)
        y = train["is_winner"].to_numpy(float)
        n, pos = len(y), y.sum()
        weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
        x1 = np.hstack([np.ones((n, 1)), x])
        penalty = np.eye(x1.shape[1]) / 0.5
        penalty[0, 0] = 0
        b = np.zeros(x1.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x1 @ b))
            grad = x1.T @ (weight * (p - y)) + penalty @ b
            b -= np.linalg.solve(x1.T @ (x1 * (weight * p * (1 - p))[:, None]) + penalty, grad)
        want = 1 / (1 + np.exp(-np.hstack([np.ones((len(t), 1)), t]) @ b))
        for row, w in zip(test.itertuples(), want):
            assert abs(got[(row.country, row.election_year, row.party)] - w) < 1e-5


def test_auc_counts_ties_half(spark):
    rnd = random.Random(1)
    data = [(rnd.randrange(2), round(rnd.random(), 1)) for _ in range(300)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "y int, s double")
    assert abs(M.roc_auc(df, "y", "s").first().value - want) < 1e-12
    assert M.roc_auc(df.where("y = 1"), "y", "s").first().value is None


def test_scores_and_wrong_winner(spark):
    data = [("a", 1, "p", 50.0, 1, 45.0), ("a", 1, "q", 40.0, 0, 46.0), ("b", 1, "p", 60.0, 1, 60.0), ("b", 1, "q", 30.0, 0, 60.0)]
    df = spark.createDataFrame(data, "country string, election_year int, party string, actual_pct double, is_winner int, baseline_vote_prediction double")
    df = df.withColumns({"baseline_error": F.col("baseline_vote_prediction") - F.col("actual_pct"), "ridge_abs_error": F.lit(1.0)})
    df = df.withColumn("baseline_abs_error", F.abs("baseline_error"))
    calls = M.winner_calls(df, "baseline_vote_prediction")
    assert rows(calls, "country", "predicted_winner", "winner_correct") == [("a", "q", 0), ("b", "p", 1)]  # tie in b goes to the first name
    wrong = M.wrong_winners(df).collect()
    assert len(wrong) == 1 and wrong[0].polling_lead_over_actual_winner == 1.0 and wrong[0].actual_lead_over_polling_winner == 10.0
    summary = {r.country: r for r in M.election_error_summary(df).collect()}
    assert summary["a"].polling_margin == 1.0 and summary["b"].polling_margin == 0.0
    scores = M.regression_metrics(df, "actual_pct", "baseline_vote_prediction").first()
    assert abs(scores.MAE - (5 + 6 + 0 + 30) / 4) < 1e-12 and abs(scores.RMSE - np.sqrt((25 + 36 + 900) / 4)) < 1e-12


def test_full_evaluation_runs(table):
    base = table.withColumn("final_rolling_avg", F.col("f1"))
    oof = M.out_of_fold(base, FEATURES)
    assert oof.count() == base.count() and oof.agg(F.max("fold_number")).first()[0] == 9
    metrics = M.evaluation_metrics(oof)
    assert metrics.count() == 9 and metrics.where("value is null").count() == 0
    ablation = M.feature_ablation(base, {"one": ["f1"], "two": ["f1", "f2"]})
    assert ablation.groupBy("feature_set").count().count() == 2
