import datetime as dt

from hustings.functions import dates as D

CASES = [
    ("12 Dec 2019", 2019, None, "2019-12-12"), ("10-11 Dec", 2019, 12, "2019-12-11"), ("October 21, 2019", 2019, None, "2019-10-21"),
    ("7-8 Aug 2010", 2010, None, "2010-08-08"), ("18 May 2019 election", 2019, None, "2019-05-18"), ("30 Jul – 1 Aug 2010", 2010, None, "2010-08-01"),
    ("30 Apr-2 May 2010", 2010, None, "2010-05-02"), ("2 – 4 Oct 2009[3]", 2009, None, "2009-10-04"), ("Election", 2019, None, None),
    ("2007 election", 2007, None, None), ("Election 2000", 2000, None, None), ("Voting result", 2019, None, None), ("Voting result[4]", 2019, None, None),
    ("April 2002", 2002, None, "2002-04-01"), ("Early Apr 1993[a]", 1993, None, "1993-04-01"), ("31 May – 2 Jun", 2019, 6, "2019-06-02"),
    ("17 Feb – 13 Mar", 2019, 3, "2019-03-13"), ("30 Dec 1998 – 3 Jan 1999", 1999, None, "1999-01-03"), ("May–Jun 2004", 2004, None, "2004-06-01"),
    ("Early May", 2019, 6, "2019-05-01"), ("Pre-23 Apr", 2019, 4, "2019-04-23"), ("28–29 Feb", 2019, 5, "2019-02-28"),
    ("20 Dec", 2010, 5, "2009-12-20"), ("3/3/2016", 2016, None, "2016-03-03"), ("16-17/23-24 Feb 2013", 2013, None, "2013-02-24"),
    ("24-25 Nov/1-2 Dec 2012", 2012, None, "2012-12-02"), ("13/5/2016", 2016, None, None), ("0 Dec 2019", 2019, None, None), (None, 2019, None, None),
    ("30 Dec 1998-3 Jan", 1999, None, None), (" 12 Dec 2019 ", 2019, None, "2019-12-12"), ("12 Foo 2019", 2019, None, None),
    ("May-Jun", 2019, None, None), ("12 Dec 0000", 2019, None, None), ("", 2019, None, None), ("31/12", 2019, None, None), ("5\u0001May\u00012019", 2019, None, None),
]


def test_forms(spark):
    df = spark.createDataFrame(CASES, "date_raw string, election_year int, hint int, expected string")
    wrong = [r for r in D.with_poll_date(df, month_hint="hint").collect() if str(r.poll_date) != str(r.expected)]
    assert wrong == []


def test_marker_flag(spark):
    df = spark.createDataFrame([("2007 ELECTION", 2007), ("Voting Result", 2007), ("3 May", 2007), (None, 2007)], "date_raw string, election_year int")
    assert [r.is_election_result for r in D.with_poll_date(df).collect()] == [True, True, False, False]


def test_two_passes_learn_the_closing_month(spark):
    df = spark.createDataFrame(
        [("a", 2019, "18 May 2019 election", 1), ("a", 2019, "20 Dec", 2), ("a", 2019, "3 Apr", 3), ("b", 2019, "20 Dec", 4)],
        "country string, election_year int, date_raw string, at int",
    )
    got = {r["at"]: r.poll_date for r in D.with_poll_date_two_pass(df, ["at"]).collect()}
    assert got == {1: dt.date(2019, 5, 18), 2: dt.date(2018, 12, 20), 3: dt.date(2019, 4, 3), 4: dt.date(2019, 12, 20)}

    known = spark.createDataFrame([("b", 2019, 2), ("c", 2019, 1)], "country string, election_year int, closing_month int")
    got = {r["at"]: r.poll_date for r in D.with_poll_date_two_pass(df, ["at"], known=known).collect()}
    assert got[4] == dt.date(2018, 12, 20) and got[2] == dt.date(2018, 12, 20)


def test_rate_and_failures(spark):
    df = D.with_poll_date(spark.createDataFrame([("x", 2000, "1 May"), ("x", 2000, "??"), ("x", 2000, "??")], "country string, election_year int, date_raw string"))
    assert D.parse_rate(df, ["country"]).first()["parsed"] == 1
    assert [r.date_raw for r in D.unparsed_samples(df).collect()] == ["??"]
