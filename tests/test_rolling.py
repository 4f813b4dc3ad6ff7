import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hustings.operators.rolling import last_observation, rolling_features, with_chunks

KEYS = ["country", "election_year", "party"]


def observations(seed, hot_day=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        party = "big" if rnd.random() < 0.6 else rnd.choice("abc")  # one series holds most rows
        day = dt.date(2020, 1, 1) if hot_day and rnd.random() < 0.5 else dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(60))
        rows.append(("x", 2020, party, day, i, rnd.uniform(0, 60)))
    return rows


def expected(rows, n):
    out = {}
    series = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        seen = series.setdefault(r[2], [])
        seen.append(r[5])
        first = seen[-1] - seen[-2] if len(seen) > 1 else None
        second = first - (seen[-2] - seen[-3]) if len(seen) > 2 else None
        out[r[4]] = (sum(seen[-n:]) / len(seen[-n:]), first, second)
    return out


@pytest.mark.parametrize("hot_day", [False, True])
@pytest.mark.parametrize("per_task,n", [(None, 5), (7, 5), (1, 3), (50, 1), (13, 8), (10**6, 5)])
def test_whole_and_chunked_series_agree(spark, hot_day, per_task, n):
    rows = observations(n, hot_day)
    df = spark.createDataFrame(rows, "country string, election_year int, party string, poll_date date, id int, pct double")
    out = rolling_features(df, ["poll_date", "id"], KEYS, window=n, rows_per_task=per_task)
    got = {r.id: (r.rolling_avg, r.momentum_1st_diff, r.momentum_2nd_diff) for r in out.collect()}
    want = expected(rows, n)
    assert got.keys() == want.keys()
    for i, figures in want.items():
        for a, b in zip(got[i], figures):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_crowded_day_is_divided(spark):
    df = spark.createDataFrame(observations(1, True), "country string, election_year int, party string, poll_date date, id int, pct double")
    sizes = with_chunks(df, KEYS, ["poll_date", "id"], 20).groupBy(*KEYS, "_block", "_part").count()
    assert sizes.agg(F.max("count")).first()[0] < 90  # the crowded day alone holds about 270 rows of one series


def test_last_observation(spark):
    df = spark.createDataFrame([("x", 1, "p", 1, 5.0), ("x", 1, "p", 2, 7.0)], "country string, election_year int, party string, at int, v double")
    assert last_observation(df, ["at"], ["v"]).first().v == 7.0


def test_null_keys_dates_and_ties_are_kept_by_both_plans(spark):
    day = [None, "2020-01-01", "2020-01-02"]
    rows = [("x" if i % 5 else None, 1, "p" if i % 3 else None, day[i % 7 % 3], i if i % 11 else None, float(i * i % 37)) for i in range(200)]
    df = spark.createDataFrame(rows, "country string, election_year int, party string, d string, id int, pct double").selectExpr("*", "cast(d as date) as poll_date")
    plans = [rolling_features(df, ["poll_date", "id", "pct"], KEYS, rows_per_task=n) for n in (None, 5, 1)]
    got = [sorted(map(str, p.select(*KEYS, "poll_date", "id", "pct", "rolling_avg", "momentum_2nd_diff").collect())) for p in plans]
    assert len(got[0]) == 200 and got[0] == got[1] == got[2]


def test_timestamps_are_cut_by_day_and_time_of_day(spark):
    df = spark.range(500).selectExpr(
        "'x' AS country", "1 AS election_year", "CASE WHEN id % 4 = 0 THEN NULL ELSE 'p' END AS party", "cast(id as int) AS id",
        "CASE WHEN id % 50 = 7 THEN NULL ELSE timestamp_seconds(1000000000 + id * id * 3 % 400000) END AS at", "cast(id * 37 % 101 as double) AS pct",
    )
    plans = [rolling_features(df, ["at", "id"], KEYS, rows_per_task=n) for n in (None, 20, 3)]
    got = [sorted(map(str, p.select(*KEYS, "at", "id", "rolling_avg", "momentum_2nd_diff").collect())) for p in plans]
    assert len(got[0]) == 500 and got[0] == got[1] == got[2]
    sizes = with_chunks(df, KEYS, ["at", "id"], 20).groupBy(*KEYS, "_block", "_part").count()
    assert sizes.agg(F.max("count")).first()[0] < 60 and with_chunks(df, KEYS, ["at", "id"], 20).select("_block").distinct().count() > 5
