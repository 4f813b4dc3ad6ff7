import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hustings.functions import scalars as SC
from hustings.operators import aggregates as AG
from hustings.operators import joins as JN
from hustings.operators import gates as GT
from hustings.operators import quality as QC
from hustings.operators import reshape as RS
from hustings.plans import dataset as D
from hustings.plans import marts as P

POLL = "country string, election_year int, party string, poll_date date, pct double, date_raw string, pollster string, is_election_result boolean, id int"


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def polls(spark):
    data = [
        ("a", 2000, "p", "2000-04-01", 40.0, "x", "S", False), ("a", 2000, "p", "2000-05-20", 44.0, "x", "S", False),
        ("a", 2000, "p", "2000-05-25", 46.0, "x", "S", False), ("a", 2000, "p", "2000-06-01", 51.0, "x", "2000 general election", False),
        ("a", 2000, "p", "2000-06-02", 99.0, "x", "S", False), ("a", 2000, "q", "2000-05-20", 30.0, "x", "S", False),
        ("a", 2000, "q", "2000-06-01", 49.0, "1 Jun 2000 election", "S", True), ("b", 1999, "p", "1999-01-01", 10.0, "x", "S", False),
    ]
    return spark.createDataFrame([(*r[:3], day(r[3]), *r[4:], i) for i, r in enumerate(data)], POLL)


@pytest.fixture(scope="module")
def dates(spark):
    return spark.createDataFrame([("a", 2000, day("2000-06-01"))], "country string, election_year int, election_date date")


def test_cutoff_and_result_rows(polls, dates):
    kept, removed = JN.split_at_cutoff(polls, dates)
    assert [r.pct for r in removed.collect()] == [99.0] and kept.count() == 7  # a cycle without a date keeps its rows
    loose = D.build_rolling(polls, dates, ["poll_date", "id"], exclude_markers="date", strict_cutoff=False)
    assert 51.0 in {r.pct for r in loose.collect()}  # a result row posing as a poll gets through
    tight = D.build_rolling(polls, dates, ["poll_date", "id"])
    assert {r.pct for r in tight.where("country = 'a'").collect()} == {40.0, 44.0, 46.0, 30.0}


def test_feature_block(spark, polls, dates):
    rolled = D.build_rolling(polls, dates, ["poll_date", "id"])
    splits = spark.createDataFrame([("a", 2000, "development")], "country string, election_year int, dataset_split string")
    dated = D.dated_features(rolled, dates, splits)
    block = {r.party: r for r in D.feature_block(dated, ["poll_date", "id"]).collect()}
    p = block["p"]
    assert (p.n_poll_observations, p.campaign_span_days, p.days_before_election) == (3, 54, 7)
    assert p.recent_30d_observations == 2 and p.recent_30d_mean == 45.0 and abs(p.recent_30d_trend_per_day - 0.4) < 1e-12
    assert abs(p.final_rolling_avg - 130 / 3) < 1e-12 and p.final_momentum_1st == 2.0 and p.final_momentum_2nd == -2.0
    q = block["q"]
    assert q.recent_30d_trend_per_day == 0.0 and q.mean_momentum_1st == 0.0 and q.poll_std == 0.0
    early = dated.where("poll_date < '2000-04-15'")
    with pytest.raises(Exception, match="recent window"):
        D.feature_block(early, ["poll_date", "id"]).collect()
    assert D.feature_block(early, ["poll_date", "id"], on_empty="null").first().recent_30d_mean is None


def test_splits(spark):
    cycles = spark.createDataFrame([("a", y) for y in (1990, 1994, 1998)] + [("b", 2000)], "country string, election_year int")
    got = {(r.country, r.election_year): r.dataset_split for r in D.chronological_split(cycles).collect()}
    assert got == {("a", 1990): "development", ("a", 1994): "holdout", ("a", 1998): "holdout", ("b", 2000): "development"}
    stored = spark.createDataFrame([("a", "1990.0")], "country string, election_year string")
    with pytest.raises(QC.QualityError):
        D.split_table(stored, stored)
    assert D.split_table(stored, stored.where("false")).first().election_year == 1990


def test_quality_gates(spark):
    data = spark.createDataFrame(
        [("a", 1, "p", 1, day("2000-01-01"), day("2000-02-01")), ("a", 1, "q", 0, day("2000-01-01"), day("2000-02-01"))],
        "country string, election_year int, party string, is_winner int, last_poll_date date, election_date date",
    )
    splits = spark.createDataFrame([("a", 1, "development")], "country string, election_year int, dataset_split string")
    D.validate_dataset(data, splits)
    for broken in (
        data.unionByName(data), data.withColumn("is_winner", F.lit(1)), data.withColumn("last_poll_date", F.lit("2001-01-01").cast("date")), data.where("false"),
    ):
        with pytest.raises(QC.QualityError):
            D.validate_dataset(broken, splits)
    with pytest.raises(QC.QualityError, match="no model rows"):
        D.validate_dataset(data, splits.unionByName(splits.withColumn("election_year", F.lit(2))))


def test_figures_are_counted_while_the_table_is_written(spark, tmp_path):
    data = spark.createDataFrame(
        [("a", 1, "p", 1, day("2000-01-01"), day("2000-02-01"), 1.0, "development"), ("a", 1, "q", 0, day("2000-03-01"), day("2000-02-01"), None, "holdout"),
         ("a", 1, "q", 0, None, day("2000-02-01"), float("inf"), None), (None, 2, None, 0, None, None, float("nan"), "development"), (None, 2, "x", None, None, None, -2.0, "development")],
        "country string, election_year int, party string, is_winner int, last_poll_date date, election_date date, v double, dataset_split string",
    )
    splits = spark.createDataFrame([("a", 1, "development"), (None, 2, "development"), ("b", 3, "holdout")], "country string, election_year int, dataset_split string")
    want = {
        "rows": 5, "cycles": 2, "repeated keys": 2, "cycles without one winner": 1, "past the cutoff": 1, "covered cycles": 2, "outside development": 2,
        "missing v": 2, "infinite v": 1,
    }
    figures = GT.dataset_figures(["v"], "development")
    path = str(tmp_path / "t")
    assert GT.write_observed(GT.flagged(data, splits), path, figures, drop=GT.FLAGS) == want
    back = spark.read.parquet(path)
    assert back.columns == data.columns and back.count() == 5
    with pytest.raises(QC.QualityError, match="duplicate keys"):
        GT.store_dataset(data, splits, str(tmp_path / "u"))
    fine = data.limit(1)
    with pytest.raises(QC.QualityError, match="no model rows"):
        GT.store_dataset(fine, splits, str(tmp_path / "v"))
    assert GT.store_dataset(fine, splits.where("country = 'a'"), str(tmp_path / "w"), ["v"])["missing v"] == 0
    with pytest.raises(QC.QualityError, match="outside holdout"):
        GT.store_dataset(fine, splits.where("country = 'a'"), str(tmp_path / "x"), split="holdout")
    with pytest.raises(QC.QualityError, match="empty"):
        GT.store_dataset(data.where("rand() > 2"), splits, str(tmp_path / "y"))


def test_winner_ties_are_caught(spark):
    truth = spark.createDataFrame([("a", 1, "p", 50.0), ("a", 1, "q", 50.0), ("b", 1, "p", 1.0)], "country string, election_year int, party string, actual_pct double")
    flagged = D.winner_flags(truth)
    assert rows(QC.wrong_winner_counts(flagged)) == [("a", 1, 2)]


def test_metadata_and_labels(spark):
    meta = spark.createDataFrame([("a", "Aland")], "country string, country_label string")
    known = spark.createDataFrame([("a", 1)], "country string, v int")
    assert SC.attach_metadata(known, meta).first().country_label == "Aland"
    with pytest.raises(Exception, match="missing metadata"):
        SC.attach_metadata(known.withColumn("country", F.lit("zz")), meta).collect()
    with pytest.raises(Exception, match="metric not found"):
        SC.metric_lookup(spark.createDataFrame([("MAE", 1.0)], "metric string, value double"), "auc").collect()
    values = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (None,)], "v double")
    assert [r[0] for r in values.select(F.bround("v", 0)).collect()] == [0.0, 2.0, 0.0, None]
    assert [r[0] for r in values.select(SC.bubble_size(F.col("v"))).collect()] == [0.75, 1.75, 0.25, 0.25]


def test_correlation_and_shape(spark):
    data = [("d1", "p", 1.0), ("d1", "q", 4.0), ("d2", "p", 2.0), ("d2", "q", 2.0), ("d2", "q", 4.0), ("d3", "p", 5.0), ("d4", "q", 9.0), ("d5", "p", 3.0), ("d5", "q", 1.0)]
    df = spark.createDataFrame(data, "d string, party string, pct double")
    got = {(r.series_a, r.series_b): r.correlation for r in AG.series_correlation(df, ["d"]).collect()}
    import numpy as np

    assert abs(got[("p", "q")] - np.corrcoef([1, 2, 3], [4, 3, 1])[0, 1]) < 1e-12 and got[("p", "p")] == 1.0 and len(got) == 4


def test_matrices(spark):
    m = spark.createDataFrame([("s1", "MAE", 1.0), ("s1", "RMSE", 2.0), ("s2", "MAE", 3.0)], "model string, metric string, value double")
    out = RS.fixed_matrix(m, "model", ["s2", "none", "s1"], "metric", ["RMSE", "MAE"], "value").collect()
    assert [(r.model, r.RMSE, r.MAE) for r in out] == [("s2", None, 3.0), ("none", None, None), ("s1", 2.0, 1.0)]


def test_filters_and_ranges(spark):
    df = spark.createDataFrame([("a", 1, day("2020-01-15")), ("a", 2, day("2020-06-30")), ("b", 1, day("2020-03-31"))], "country string, v int, poll_date date")
    assert P.optional_filters(df, country="All", v=None).count() == 3
    assert P.optional_filters(df, country=["a"], v=2).count() == 1
    assert P.trailing_range(df, 3, ["country"]).count() == 2 and P.trailing_range(df, None, ["country"]).count() == 3
