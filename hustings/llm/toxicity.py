"""Severity grades of texts by ordinal regression with a cumulative logit link.

P(grade > k) = logistic(w . x - theta_k): the thresholds theta are ordered and share the weights w. Features x are
log(1 + count) of selected words and word beginnings. The model is fitted on a bounded sample of labelled rows; every
whole text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: Labelled documents of each grade that the model is fitted on, at most.
SAMPLE_PER_GRADE = 4000
#: Features that the model keeps.
FEATURES = 512
#: Lengths of word beginnings used beside whole words.
STEMS = (4, 5, 6)
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """A whole word and its beginnings; words shorter than the shortest beginning have none."""
    if len(word) < STEMS[0]:
        return []
    return ["=" + word, *("^" + word[:n] for n in STEMS if len(word) >= n)]


@dataclass
class OrdinalModel:
    """Ordered grades with their thresholds, and the weight of each feature."""

    grades: list[int]
    thresholds: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and weights by penalised Fisher scoring with step halving; ``y`` holds 0 .. K-1, each present.

    A row counts as ``times`` rows (once by default).
    """
    n, m = x.shape
    k = int(y.max())
    times = np.ones(n) if times is None else times
    share = np.array([np.average(y > j, weights=times) for j in range(k)]).clip(1e-12, 1 - 1e-12)
    par = np.concatenate([-np.log(share / (1 - share)), np.zeros(m)])
    x = x.astype(np.float64)

    def terms(par: np.ndarray):
        theta, w = par[:k], par[k:]
        z = (x @ w)[:, None] - theta[None, :]
        up = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(z, -500, 500))), np.zeros((n, 1))], axis=1)
        p = np.maximum(up[np.arange(n), y] - up[np.arange(n), y + 1], 1e-12)
        return up, p, (times * np.log(p)).sum() - 0.5 * ridge * (w @ w)

    up, p, value = terms(par)
    for _ in range(rounds):
        slope = up * (1 - up)  # of P(grade > j) by its argument; 0 at both ends
        d_low, d_high = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        score_z = times * (d_low - d_high) / p  # derivative of times * log p by the score
        grad_theta = np.array([-(times * d_low * (y == j + 1) / p).sum() + (times * d_high * (y == j) / p).sum() for j in range(k)])
        grad = np.concatenate([grad_theta, x.T @ score_z - ridge * par[k:]])
        probs = np.maximum(up[:, :-1] - up[:, 1:], 1e-12)
        info_z = times * ((slope[:, :-1] - slope[:, 1:]) ** 2 / probs).sum(axis=1)
        info = np.zeros((k + m, k + m))
        info[k:, k:] = (x * info_z[:, None]).T @ x + ridge * np.eye(m)
        for j in range(k):
            above, below = (slope[:, j + 1] - slope[:, j + 2]) / probs[:, j + 1], (slope[:, j] - slope[:, j + 1]) / probs[:, j]
            cross = -times * slope[:, j + 1] * (above - below)
            info[j, k:] = info[k:, j] = x.T @ cross
            info[j, j] = (times * slope[:, j + 1] ** 2 * (1 / probs[:, j] + 1 / probs[:, j + 1])).sum()
            if j + 1 < k:
                info[j, j + 1] = info[j + 1, j] = -(times * slope[:, j + 1] * slope[:, j + 2] / probs[:, j + 1]).sum()
        step = np.linalg.solve(info + 1e-8 * np.eye(k + m), grad)
        size = 1.0
        while size > 1e-6:
            trial = par + size * step
            if np.all(np.diff(trial[:k]) > 0):
                t_up, t_p, t_value = terms(trial)
                if t_value >= value:
                    break
            size /= 2
        else:
            break
        gain, par, up, p, value = t_value - value, trial, t_up, t_p, t_value
        if gain < 1e-7 * (1 + abs(value)):
            break
    return par[:k], par[k:]


def _counted(texts: pa.Array, wanted: dict[str, int], begins: set[str]) -> Iterator[dict[int, int]]:
    """Counts of the wanted features in each text."""
    short = STEMS[0]
    for text in texts.to_pylist():
        counts: dict[int, int] = {}
        for word in _WORD.findall(text.lower()) if text else ():
            if word[:short] in begins:
                for name in word_features(word):
                    at = wanted.get(name)
                    if at is not None:
                        counts[at] = counts.get(at, 0) + 1
        yield counts


def fit_severity(docs: DataFrame, labels: DataFrame, grade: str = "toxic", per_grade: int = SAMPLE_PER_GRADE, features: int = FEATURES) -> OrdinalModel:
    """Fit on at most ``per_grade`` labelled documents of each grade, taken in the order of a hash of their ids.

    Where a grade has more labels than that, its sampled rows count for all of them, so the fit sees the grades in the
    shares of the labels at every size of the table. Any integer grades serve, in their order (two grades make one
    threshold). Word statistics of the sample are summed
    by Spark; the ``features`` features that differ most in mean grade are kept, and only their sparse rows of the
    bounded sample come to the driver. Without labels, or with one grade, the model gives that grade (or 0) to all.
    """
    graded = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    chosen, sizes = bounded_sample(graded, "grade", per_grade)
    times = {g: sizes[g] / n for g, n in chosen.groupBy("grade").count().collect()}
    # A broadcast of the sample: per_grade ids per grade at most.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[int, Counter] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n.setdefault(y, Counter()).update({f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)})
            for y, found in n.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array([y] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
                    names=["feature", "grade", "n"],
                )

    seen = sample.select("text", "grade").mapInArrow(presence, "feature string, grade int, n long").groupBy("feature", "grade").agg(F.sum("n").alias("n"))
    tally = dict(sample.select("doc_id", "grade").groupBy("grade").count().collect())
    grades = sorted(tally)
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros(0))
    size = sum(times[g] * c for g, c in tally.items())
    mean = sum(g * times[g] * c for g, c in sorted(tally.items())) / size
    spread = sum((g - mean) ** 2 * times[g] * c for g, c in sorted(tally.items())) / size
    # Added up in the order of the grades: the same sums in every run.
    weight = F.create_map(*[F.lit(v) for g in grades for v in (g, float(times[g]))])
    each = seen.groupBy("feature").agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("grade", (F.col("n") * weight[F.col("grade")]).alias("n")))).alias("each"))
    stats = each.select(
        "feature", "rows",
        F.aggregate("each", F.lit(0.0), lambda a, e: a + e["n"]).alias("n"),
        F.aggregate("each", F.lit(0.0), lambda a, e: a + e["n"] * e["grade"]).alias("total"),
    )
    # The number of features is a parameter, so this is a top-k.
    lift = (F.col("total") - F.col("n") * F.lit(mean)) / F.sqrt(F.col("n") * F.lit(spread))
    best = stats.where("rows >= 3").orderBy(lift.desc(), "feature").limit(features)
    names = [r[0] for r in best.select("feature").collect()]
    wanted = {f: i for i, f in enumerate(names)}
    begins = {f[1 : 1 + STEMS[0]] for f in names}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, much = [], []
            for counts in _counted(batch.column(0), wanted, begins):
                at.append(list(counts))
                much.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(much, pa.list_(pa.int32()))], names=["grade", "at", "much"])

    data = sample.select("text", "grade").mapInArrow(rows, "grade int, at array<int>, much array<int>").collect()
    x, y = np.zeros((len(data), len(names)), np.float32), np.zeros(len(data), np.int64)
    for i, (g, at, much) in enumerate(data):
        x[i, at] = np.log1p(much)
        y[i] = grades.index(g)
    thresholds, weights = fit_ordinal(x, y, times=np.array([times[g] for g in grades])[y])
    return OrdinalModel(grades, thresholds, {f: float(w) for f, w in zip(names, weights)})


def _scores(model: OrdinalModel) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Scores a text column: for each text the probabilities of the grades, lowest first, and the most probable grade."""
    names = list(model.weights)
    weights = np.array(list(model.weights.values()))
    wanted, begins = {f: i for i, f in enumerate(names)}, {f[1 : 1 + STEMS[0]] for f in names}
    grades = np.array(model.grades, float)

    def score(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sums = np.array([sum(weights[i] * np.log1p(c) for i, c in counts.items()) for counts in _counted(texts, wanted, begins)], float)
        ends = np.concatenate([np.ones((len(sums), 1)), model.exceed(sums), np.zeros((len(sums), 1))], axis=1)
        each = ends[:, :-1] - ends[:, 1:]
        return each, grades[each.argmax(axis=1)]

    return score


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, grade, expected_severity, p_above) of every row: the most probable grade, the mean of the grades, and the
    probability of more than the lowest grade.

    A null or empty text has no features, so its score is that of a text without any telling word. Rows that repeat a
    doc_id are each scored. Other columns are ignored; an empty table gives no rows.
    """
    score, grades = _scores(model), np.array(model.grades, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, grade = score(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grade.astype(np.int32)), pa.array(each @ grades), pa.array(1 - each[:, 0])],
                names=["doc_id", "grade", "expected_severity", "p_above"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, grade int, expected_severity double, p_above double")


def accepted(docs: DataFrame, model: OrdinalModel, least: int = 1) -> DataFrame:
    """The rows whose grade is below ``least``. Each row is judged by its own text, whatever its id; columns are unchanged."""
    score, at = _scores(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, grade = score(batch.column(at).cast(pa.string()))
            yield batch.filter(pa.array(grade < least))

    return docs.mapInArrow(run, docs.schema)
