import itertools
import zlib
from collections import Counter

import numpy as np

from hustings.llm import language_id as L
from hustings.llm import toxicity as X
from hustings.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_language_spans"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", L.F.when(L.fold_of("doc_id") == 2, "xx").otherwise(L.F.col("lang")))
    a, b = L.learn(L.learnable(docs)), L.learn(L.learnable(changed))
    assert a.languages == b.languages and np.array_equal(a.log_p, b.log_p)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    per_text = np.array([3, 0, 5, 1, 6])
    scores = rng.normal(size=(15, 3)).astype(np.float32) * 3
    label, at = L.viterbi(scores, per_text, 2.0), 0
    for n in per_text.tolist():
        if n:
            value = lambda p: sum(scores[at + i, p[i]] for i in range(n)) - 2 * sum(p[i] != p[i + 1] for i in range(n - 1))  # noqa: B023, E731
            assert tuple(label[at : at + n]) == max(itertools.product(range(3), repeat=n), key=value)
        at += n


def test_spans_of_mixed_text_and_scripts(spark):
    english, german = "the cat and the dog went with them to that other house", "der hund und die katze gehen nicht mit ihnen nach haus"
    russian = "это большой дом и маленькая собака"
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(english, "en"), (german, "de"), (russian, "ru")] * 5)], "doc_id long, text string, lang string")
    model = L.learn(train)
    text = f"{english}, {german}. {russian}!"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "12 $%"), (4, "漢字")], "doc_id long, text string")
    spans = sorted(L.language_spans(docs.where("doc_id = 1"), model).collect(), key=lambda r: r.begin)
    assert [r.lang for r in spans] == ["en", "de", "ru"]
    assert text[spans[1].begin : spans[1].end] == german and spans[2].end == len(text) - 1
    pred = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, model).collect()}
    assert pred[2] == pred[3] == ("und", 0.0) and pred[4][0] in model.languages


def test_language_of_odd_rows(odd_docs, no_docs):
    model = L.learn(L.learnable(odd_docs))
    rows = L.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    empty = L.learn(L.learnable(no_docs))
    assert empty.languages == [] and L.identify(no_docs, model).count() == 0
    assert {r.lang_pred for r in L.identify(odd_docs, empty).collect()} == {"und"}


def test_ordinal_fit_recovers_known_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    u = x @ np.array([1.0, -2.0, 0.5]) + rng.logistic(size=4000)
    y = (u > -1).astype(int) + (u > 1) + (u > 3)
    thresholds, weights = X.fit_ordinal(x, y, 0.01)
    assert np.allclose(thresholds, [-1, 1, 3], atol=0.2) and np.allclose(weights, [1, -2, 0.5], atol=0.15)


def test_toxic_documents_are_graded(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = X.F.pmod(X.F.crc32(X.F.col("doc_id").cast("string").cast("binary")), X.F.lit(5)) == 0
    model = X.fit_severity(docs, labels.where(~fold))
    truth = {r.doc_id: r.toxic for r in labels.where(fold).collect()}
    found = Counter((truth[r.doc_id], r.grade) for r in X.severity(docs, model).collect() if r.doc_id in truth)
    assert found[1, 1] >= 0.85 * (found[1, 1] + found[1, 0])  # a few labelled texts hold no telling word
    assert found[0, 1] <= 0.02 * (found[0, 1] + found[0, 0])


def test_three_grades_and_odd_rows(spark, odd_docs, no_docs):
    rows = [(i, " ".join(["plain"] * 5 + ["awful"] * (i % 3 > 0) + ["dreadful"] * (i % 3 > 1))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(90)], "doc_id long, toxic int")
    model = X.fit_severity(docs, labels)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in X.severity(docs, model).collect()}
    assert all(got[i].grade == i % 3 for i in range(90))
    assert got[0].expected_severity < got[1].expected_severity < got[2].expected_severity
    odd = X.severity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and {r.grade for r in odd} == {0}
    assert X.severity(no_docs, model).count() == 0
    none = X.fit_severity(odd_docs, labels.where("false"))
    assert {(r.grade, r.expected_severity) for r in X.severity(odd_docs, none).collect()} == {(0, 0.0)}
    same = X.fit_severity(docs, labels.where("toxic = 1"))
    assert {r.grade for r in X.severity(docs, same).collect()} == {1}


def test_capped_sample_keeps_the_shares_of_the_grades(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    whole = X.fit_severity(docs, labels)
    capped = X.fit_severity(docs, labels, per_grade=labels.where("toxic = 1").count())
    assert abs(whole.thresholds[0] - capped.thresholds[0]) < 0.3


def test_rows_that_count_several_times():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.logistic(size=300) > 0).astype(int) + (x[:, 1] > 1)
    times = rng.integers(1, 5, 300)
    for a, b in zip(X.fit_ordinal(x, y, times=times.astype(float)), X.fit_ordinal(np.repeat(x, times, axis=0), np.repeat(y, times))):
        assert np.allclose(a, b, atol=1e-4)


def test_labels_of_a_very_long_text_do_not_drift():
    n = 500_000  # their log probabilities add up to far beyond what single precision resolves
    scores = np.full((n, 2), -30.25, np.float32)
    scores[: n // 2, 0] = scores[n // 2 :, 1] = -30.0
    label = L.viterbi(scores, np.array([n]), switch=12.0)
    assert (label[: n // 2] == 0).all() and (label[n // 2 :] == 1).all()
