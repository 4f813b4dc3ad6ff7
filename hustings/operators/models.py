"""Leave-one-cycle-out models and their scores (ML1-ML14).

Ridge needs no refit per fold: per-cycle moments are aggregated once, a fold's training moments are total minus own,
and the small systems are solved row by row inside tasks. Logistic fits of all folds share their passes over the rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ENTITY_CYCLE
from ..session import cut_lineage
from ..sizing import bounded_values, null_safe_join
from .ordering import best_row, numbered_folds, running_total_before, top_two_margin

# Feature sets and regularisation strengths.
FEATURE_SETS = {
    "legacy_broad": ["final_rolling_avg", "poll_std", "days_before_election", "n_poll_observations"],
    "recent_compact": [
        "recent_30d_mean", "recent_30d_std", "recent_30d_observations", "recent_30d_trend_per_day",
        "days_before_election",
    ],
    "final_plus_recent": [
        "final_rolling_avg", "recent_30d_mean", "recent_30d_std", "recent_30d_observations",
        "recent_30d_trend_per_day", "final_vs_recent_30d_mean", "days_before_election",
    ],
}
RIDGE_ALPHA = 10.0
LOGISTIC_C = 0.5
#: Folds whose sums a task holds at once; more are fitted block by block.
FOLDS_PER_PASS = 512


def _design(features: list[str], entity: str, categories: list[str], centre: dict[str, float]) -> list[Column]:
    """Shifted numeric features followed by 0/1 entity columns (ML3); an entity unseen in training adds nothing."""
    numeric = [F.col(f).cast("double") - F.lit(centre[f]) for f in features]
    return numeric + [F.coalesce((F.col(entity) == c).cast("double"), F.lit(0.0)) for c in categories]


def _centre(df: DataFrame, features: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    return {f: float(row[f] or 0.0) for f in features}


def ridge_coefficients(
    df: DataFrame, features: list[str], target: str = "actual_pct", keys: list[str] = ENTITY_CYCLE,
    entity: str = "country", alpha: float = RIDGE_ALPHA,
) -> tuple[DataFrame, list[str], dict[str, float]]:
    """ML2-ML4: one row per held-out cycle with the intercept and coefficients fitted on all other cycles.

    Moments are taken about the overall means, so totals minus a cycle lose no precision.
    """
    categories = bounded_values(df, entity)
    centre = _centre(df, features)
    x = _design(features, entity, categories, centre)
    p, q = len(x), len(features)
    y = F.col(target).cast("double")
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.lit(1.0), y, *x, *[xi * y for xi in x], *[x[i] * x[j] for i, j in upper]]
    named = [F.sum(s).alias(f"m{i}") for i, s in enumerate(sums)]
    moments = df.groupBy(*keys).agg(*named).select(*keys, F.array(*[f"m{i}" for i in range(len(sums))]).alias("own"))
    moments = cut_lineage(moments)
    total = np.array(moments.agg(*[F.sum(F.col("own")[i]) for i in range(len(sums))]).first(), dtype=float)

    def solve(batches):
        for pdf in batches:
            fitted = []
            for own in pdf["own"]:
                m = total - np.asarray(own, dtype=float)
                n, sy, sx, sxy = m[0], m[1], m[2 : 2 + p], m[2 + p : 2 + 2 * p]
                sxx = np.zeros((p, p))
                for value, (i, j) in zip(m[2 + 2 * p :], upper):
                    sxx[i, j] = sxx[j, i] = value
                if n < 1:
                    fitted.append([np.nan] * (p + 1))
                    continue
                mean = sx / n
                variance = np.diag(sxx) / n - mean**2
                scale = np.ones(p)
                spread = variance[:q] > 1e-12 * np.maximum(np.diag(sxx)[:q] / n, 1e-12)
                scale[:q] = np.where(spread, np.sqrt(np.maximum(variance[:q], 0.0)), 1.0)
                gram = (sxx - n * np.outer(mean, mean)) / np.outer(scale, scale)
                slope = np.linalg.solve(gram + alpha * np.eye(p), (sxy - mean * sy) / scale) / scale
                fitted.append([sy / n - float(slope @ mean), *slope])
            out = pdf[keys].copy()
            out["beta"] = [list(map(float, b)) for b in fitted]
            yield out

    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", beta array<double>"
    return moments.mapInPandas(solve, schema), categories, centre


def _linear(beta: Column, x: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [beta[i + 1] * xi for i, xi in enumerate(x)], beta[0])


def ridge_predictions(
    df: DataFrame, features: list[str], out: str = "ridge_vote_prediction", target: str = "actual_pct",
    keys: list[str] = ENTITY_CYCLE, entity: str = "country", alpha: float = RIDGE_ALPHA,
) -> DataFrame:
    """ML2 / ML4: out-of-fold ridge predictions."""
    betas, categories, centre = ridge_coefficients(df, features, target, keys, entity, alpha)
    x = _design(features, entity, categories, centre)
    return df.join(betas, keys).withColumn(out, _linear(F.col("beta"), x)).drop("beta")


def logistic_predictions(
    df: DataFrame, features: list[str], out: str = "logistic_win_probability", label: str = "is_winner",
    keys: list[str] = ENTITY_CYCLE, entity: str = "country", c: float = LOGISTIC_C,
) -> DataFrame:
    """ML5: out-of-fold win probabilities; balanced class weights, penalty 1/C on standardised features.

    All folds are fitted together: a Newton step of every fold is one pass over the rows, in which each task adds up
    gradients and Hessians. One row per fold comes to the driver. A fold whose training rows have one class has NULL.
    """
    categories = bounded_values(df, entity)
    centre = _centre(df, features)
    x = _design(features, entity, categories, centre)
    q = len(features)
    rows = cut_lineage(df.select(*keys, F.col(label).cast("double").alias("y"), F.array(*x).alias("x")))
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(q)] + [F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in range(q)]
    own = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("pos"), *sums).collect()
    table = np.array([[float(v or 0.0) for v in r[len(keys) :]] for r in own]).reshape(len(own), 2 + 2 * q)
    rest = table.sum(axis=0) - table
    n, pos = rest[:, 0], rest[:, 1]
    mean = rest[:, 2 : 2 + q] / np.maximum(n, 1)[:, None]
    variance = rest[:, 2 + q :] / np.maximum(n, 1)[:, None] - mean**2
    scale = np.ones((len(own), len(x)))
    scale[:, :q] = np.where(variance > 1e-12, np.sqrt(np.maximum(variance, 0.0)), 1.0)
    two = (pos > 0) & (pos < n)
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    spark = df.sparkSession
    number = spark.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(own)], schema + ", fold int")
    numbered = null_safe_join(rows, number, keys).select("fold", "y", "x")
    beta = np.full((len(own), len(x) + 1), np.nan)
    for start in range(0, len(own), FOLDS_PER_PASS):
        block = np.arange(start, min(start + FOLDS_PER_PASS, len(own)))
        block = block[two[block]]
        if len(block):
            weights = np.stack([n / (2 * np.maximum(n - pos, 1)), n / (2 * np.maximum(pos, 1))], axis=1)[block]
            beta[block] = _newton(numbered, block, weights, scale[block] ** 2 / c)
    betas = [(*[r[k] for k in keys], None if np.isnan(b).any() else list(map(float, b))) for r, b in zip(own, beta)]
    coefficients = spark.createDataFrame(betas, schema + ", beta array<double>")
    score = _linear(F.col("beta"), x)
    return null_safe_join(df, coefficients, keys).withColumn(out, 1.0 / (1.0 + F.exp(-score))).drop("beta")


def _newton(rows: DataFrame, folds: np.ndarray, weights: np.ndarray, penalty: np.ndarray, most: int = 100) -> np.ndarray:
    """Intercept and coefficients of each fold, fitted on the rows (fold, y, x) of all others.

    ``weights``: of the two classes, by fold; ``penalty``: of each squared coefficient, halved, by fold. A step that makes
    a fold worse is halved.
    """
    m = penalty.shape[1] + 1
    ridge = np.concatenate([np.zeros((len(folds), 1)), penalty], axis=1)
    sides = [(i, j) for i in range(m) for j in range(i, m)]
    low, high = np.array(sides).T

    def sums(beta: np.ndarray) -> np.ndarray:
        def part(batches):
            total = np.zeros((len(folds), 1 + m + len(sides)))
            for pdf in batches:
                if len(pdf):
                    a = np.hstack([np.ones((len(pdf), 1)), np.stack(pdf["x"].to_numpy())])
                    y, g = pdf["y"].to_numpy(float), pdf["fold"].to_numpy()
                    z = a @ beta.T
                    w = np.where(y[:, None] == 1, weights[:, 1], weights[:, 0]) * (g[:, None] != folds[None, :])
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    total[:, 0] += (w * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
                    total[:, 1 : 1 + m] += (w * (p - y[:, None])).T @ a
                    total[:, 1 + m :] += (w * p * (1 - p)).T @ (a[:, low] * a[:, high])
            yield pd.DataFrame({"at": np.arange(len(folds), dtype=np.int32), "s": list(total)})

        def add(key, pdf):
            return pd.DataFrame({"at": [key[0]], "s": [np.sum(np.stack(pdf["s"].to_numpy()), axis=0)]})

        kind = "at int, s array<double>"
        got = rows.mapInPandas(part, kind).groupBy("at").applyInPandas(add, kind).collect()
        return np.array([r.s for r in sorted(got)])

    held = np.zeros((len(folds), m))
    step, best, state = np.zeros_like(held), np.full(len(folds), np.inf), None
    for _ in range(most):
        trial = held + step
        s = sums(trial)
        value = s[:, 0] + 0.5 * (ridge * trial**2).sum(axis=1)
        worse = value > best + 1e-9 * np.abs(best)
        state = s if state is None else np.where(worse[:, None], state, s)
        held = np.where(worse[:, None], held, trial)
        best = np.where(worse, best, value)
        hessian = np.zeros((len(folds), m, m))
        hessian[:, low, high] = hessian[:, high, low] = state[:, 1 + m :]
        hessian += np.eye(m) * (ridge[:, None, :] + 1e-12)
        newton = -np.linalg.solve(hessian, (state[:, 1 : 1 + m] + ridge * held)[:, :, None])[:, :, 0]
        step = np.where(worse[:, None], step / 2, newton)
        if np.abs(step).max() < 1e-10 * (1 + np.abs(held).max()):
            break
    return held


def out_of_fold(df: DataFrame, features: list[str], keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """ML1-ML5: benchmark, ridge and logistic out-of-fold columns, with fold numbers (WN11)."""
    base = cut_lineage(df).withColumn("baseline_vote_prediction", F.col("final_rolling_avg"))
    scored = logistic_predictions(ridge_predictions(base, features, keys=keys), features, keys=keys)
    return scored.join(numbered_folds(base, keys), keys)


def feature_ablation(df: DataFrame, sets: dict[str, list[str]] = FEATURE_SETS) -> DataFrame:
    """ML6: out-of-fold predictions of every feature set, tagged."""
    parts = [out_of_fold(df, features).withColumn("feature_set", F.lit(name)) for name, features in sets.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """ML7: MAE and RMSE."""
    error = F.col(predicted) - F.col(actual)
    return df.groupBy(*(by or [])).agg(F.avg(F.abs(error)).alias("MAE"), F.sqrt(F.avg(error * error)).alias("RMSE"))


def flag_predicted_winner(df: DataFrame, score: str, out: str, keys: list[str] = ENTITY_CYCLE, tie: str = "party") -> DataFrame:
    """WN5: 1 on the row with the highest score of its cycle, ties by series name."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(out, (F.row_number().over(w) == 1).cast("int"))


def winner_calls(df: DataFrame, score: str, keys: list[str] = ENTITY_CYCLE, series: str = "party") -> DataFrame:
    """ML8: true and predicted winner per cycle."""
    called = best_row(df, keys, [F.col(score).desc(), F.col(series)], [series]).withColumnRenamed(series, "predicted_winner")
    actual = df.where(F.col("is_winner") == 1).select(*keys, F.col(series).alias("actual_winner"))
    both = actual.join(called, keys)
    return both.withColumn("winner_correct", (F.col("actual_winner") == F.col("predicted_winner")).cast("int"))


def winner_accuracy(calls: DataFrame) -> DataFrame:
    return calls.agg(F.avg("winner_correct").alias("value"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ML9: Mann-Whitney over distinct scores; equal scores count half."""
    by_score = df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"), F.sum((1 - F.col(label)).cast("long")).alias("_neg")
    )
    ranked = running_total_before(by_score, score, "_neg", "_neg_below")
    won = F.col("_pos") * (F.col("_neg_below") + 0.5 * F.col("_neg"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return ranked.agg((F.sum(won) / F.when(pairs > 0, pairs)).alias("value"))


def row_accuracy(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """ML10."""
    return df.agg(F.avg(((F.col(score) >= threshold).cast("int") == F.col(label)).cast("int")).alias("value"))


def metric_rows(parts: list[tuple[str, str, str, DataFrame]], extra: dict[str, str] | None = None) -> DataFrame:
    """ML11: long table (task, model, metric, value) from one-row frames with a ``value`` column."""
    tagged = [
        df.select(
            *[F.lit(v).alias(k) for k, v in (extra or {}).items()],
            F.lit(task).alias("task"), F.lit(model).alias("model"), F.lit(metric).alias("metric"),
            F.col("value").cast("double").alias("value"),
        )
        for task, model, metric, df in parts
    ]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def evaluation_metrics(oof: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """ML11: scores of benchmark, ridge and logistic out-of-fold columns."""
    share, winner = "vote_share_regression", "winner_classification"
    parts = []
    for model, column in (
        ("final_polling_average", "baseline_vote_prediction"), ("ridge_regression", "ridge_vote_prediction"),
    ):
        scores = regression_metrics(oof, "actual_pct", column)
        for metric in ("MAE", "RMSE"):
            parts.append((share, model, metric, scores.select(F.col(metric).alias("value"))))
    for model, column in (
        ("final_polling_average", "baseline_vote_prediction"), ("ridge_regression", "ridge_vote_prediction"),
        ("logistic_regression", "logistic_win_probability"),
    ):
        parts.append((winner, model, "election_winner_accuracy", winner_accuracy(winner_calls(oof, column))))
    parts.append((winner, "logistic_regression", "OOF_ROC_AUC", roc_auc(oof, "is_winner", "logistic_win_probability")))
    parts.append(
        (winner, "logistic_regression", "row_accuracy_at_0.5", row_accuracy(oof, "is_winner", "logistic_win_probability"))
    )
    return metric_rows(parts, extra)


def holdout_predictions(df: DataFrame) -> DataFrame:
    """ML12: benchmark prediction, errors and predicted-winner flag."""
    error = F.col("final_rolling_avg") - F.col("actual_pct")
    scored = df.withColumns(
        {"selected_vote_prediction": F.col("final_rolling_avg"), "vote_share_error": error, "absolute_error": F.abs(error)}
    )
    return flag_predicted_winner(scored, "selected_vote_prediction", "selected_model_predicted_winner")


def election_results(predictions: DataFrame, score: str, keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """ML12: per cycle the called and the true winner with both margins (NULL margin for a single series)."""
    picked = best_row(
        predictions, keys, [F.col(score).desc(), F.col("party")], ["party", score, "actual_pct"]
    ).withColumnsRenamed(
        {"party": "predicted_winner", score: "predicted_winner_polling_pct", "actual_pct": "predicted_winner_actual_pct"}
    )
    actual = predictions.where(F.col("is_winner") == 1).select(*keys, F.col("party").alias("actual_winner"))
    polled = top_two_margin(predictions, keys, score, "party", "predicted_margin").select(*keys, "predicted_margin")
    true = top_two_margin(predictions, keys, "actual_pct", "party", "actual_margin").select(*keys, "actual_margin")
    out = actual.join(picked, keys).join(polled, keys).join(true, keys)
    return out.withColumn("winner_correct", (F.col("actual_winner") == F.col("predicted_winner")).cast("int"))


def election_error_summary(df: DataFrame, score: str = "baseline_vote_prediction", keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """ML14: per cycle rows, winners, the true winner's polling, both margins and mean absolute errors."""
    sizes = df.groupBy(*keys).agg(
        F.count("*").alias("party_rows"),
        F.avg("baseline_abs_error").alias("election_baseline_mae"),
        F.avg("ridge_abs_error").alias("election_ridge_mae"),
    )
    winners = df.where(F.col("is_winner") == 1).select(
        *keys,
        F.col("actual_pct").alias("actual_winner_pct"),
        F.col(score).alias("actual_winner_polling_average"),
        F.col("baseline_error").alias("actual_winner_poll_error"),
    )
    results = election_results(df, score, keys).select(
        *keys, "actual_winner", F.col("predicted_winner").alias("polling_winner"), "winner_correct", "actual_margin",
        F.col("predicted_margin").alias("polling_margin"),
    )
    return sizes.join(winners, keys).join(results, keys)


def wrong_winners(df: DataFrame, score: str = "baseline_vote_prediction", keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """ML13: cycles where the polled leader lost, with both series' figures and the reversal of the lead."""
    def side(rows: DataFrame, who: str) -> DataFrame:
        return rows.select(
            *keys,
            F.col("party").alias(who),
            F.col("actual_pct").alias(f"{who}_actual_pct"),
            F.col(score).alias(f"{who}_polling_pct"),
            F.col("baseline_error").alias(f"{who}_poll_error"),
        )

    actual = side(df.where(F.col("is_winner") == 1), "actual_winner")
    polled = side(best_row(df, keys, [F.col(score).desc(), F.col("party")]), "polling_winner")
    both = actual.join(polled, keys).where(F.col("actual_winner") != F.col("polling_winner"))
    return both.withColumns(
        {
            "polling_lead_over_actual_winner": F.col("polling_winner_polling_pct") - F.col("actual_winner_polling_pct"),
            "actual_lead_over_polling_winner": F.col("actual_winner_actual_pct") - F.col("polling_winner_actual_pct"),
        }
    )
