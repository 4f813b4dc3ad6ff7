import pytest
from pyspark.sql import functions as F

from conftest import rows
from hustings.functions.text import is_result_row, marker_relevance
from hustings.operators import scope as S


@pytest.mark.parametrize(
    "relevance,overlap,mae,worst,status",
    [
        ("g", 1, 0.1, 0.1, "review"), ("g", 2, 1.5, 3.0, "approved_marker_match"), ("g", 2, 1.6, 3.0, "review"),
        ("g", 2, 3.0, 3.1, "rejected_marker_mismatch"), ("g", 2, 2.0, 6.0, "rejected_marker_mismatch"), ("g", 3, 1.0, 3.1, "review"),
        (None, None, None, None, "review"), ("g", 0, None, None, "review"),
    ],
)
def test_thresholds(spark, relevance, overlap, mae, worst, status):
    df = spark.createDataFrame([(relevance, overlap, mae, worst)], "r string, o int, m double, w double")
    assert df.select(S.scope_decision(F.col("r"), F.col("o"), F.col("m"), F.col("w"))[0]).first()[0] == status


def test_whole_field_markers_and_years(spark):
    data = [("Voting results", None), ("Election [3]", ""), ("3 May", "2010 general election"), ("3 May", "Election Forecast"), ("by-election", None), (None, "general election[a]")]
    df = spark.createDataFrame(data, "d string, p string")
    assert [r[0] for r in df.select(is_result_row(F.col("d"), F.col("p"))).collect()] == [True, True, True, False, False, True]
    years = spark.createDataFrame([("x | 2010 general election", 2010), ("2006 | 2010", 2010), ("2006", 2010), ("12010", 2010)], "t string, y int")
    got = [r[0] for r in years.select(marker_relevance(F.col("t"), F.col("y"))).collect()]
    assert got == ["explicit_current_year", "explicit_current_year", "historical_other_year", "generic_current_candidate"]


def test_audit_and_fail_closed_filter(spark):
    schema = "country string, election_year int, source_table string, date_raw string, pollster string, party string, pct double"
    polls = spark.createDataFrame(
        [("uk", 2010, "t1", "Election", None, "CON", 36.0), ("uk", 2010, "t1", "Election", None, "LD", 23.0), ("uk", 2010, "t1", "1 May", "Y", "CON", 34.0),
         ("uk", 2010, "t2", "1 May", "Y", "CON", 34.0), ("uk", 2010, "t3", "1 May", "2005 general election", "CON", 36.0), ("uk", 2010, "t9", "1 May", "Y", "CON", 1.0)],
        schema,
    )
    truth = spark.createDataFrame([("uk", 2010, "CON", 36.1), ("uk", 2010, "LIB", 23.0)], "country string, election_year int, party string, actual_pct double")
    comparable = S.comparable_polls(polls, {("uk", "LD"): "LIB"})
    audit = S.scope_audit(comparable, S.marker_candidates(comparable, truth))
    by = {r.source_table: r for r in audit.collect()}
    assert by["t1"].scope_status == "approved_marker_match" and by["t1"].party_signature == "CON|LD"
    assert by["t3"].scope_status == "review" and by["t3"].marker_candidate_count == 1 and by["t3"].best_marker_relevance == ""
    overrides = spark.createDataFrame([("uk", 2010, "t2", "manual_approved", "seen", "e")], "country string, election_year int, source_table string, override_status string, reason string, evidence string")
    approved, excluded, kept, dropped = S.apply_scope(polls, audit.where("source_table <> 't9'"), overrides)
    assert {r.source_table for r in approved.collect()} == {"t1", "t2"}
    assert rows(dropped, "source_table", "effective_scope_status") == [("t3", "review"), ("t9", "unclassified")]
    assert approved.columns == polls.columns


def test_duplicate_keys_of_a_lookup_fail(spark):
    from hustings.operators.joins import many_to_one, one_to_one

    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("c", 11), (None, 12), (None, 13)], "k string, w int")
    assert sorted((r.v, r.w) for r in many_to_one(left, right, ["k"]).collect() if r.k) == [(1, 10)]
    twice = right.unionByName(right)
    for join in (lambda: many_to_one(left, twice, ["k"]), lambda: one_to_one(left, twice, ["k"])):
        with pytest.raises(Exception, match="duplicate keys"):
            join().collect()
    assert many_to_one(left, twice, ["k"], check=False).count() == 2


def test_a_lot_decided_twice_fails(spark):
    from hustings.operators import scope as S

    keys = ", ".join(f"{k} {'int' if k == 'election_year' else 'string'}" for k in S.LOT_KEYS)
    lot = tuple(1997 if k == "election_year" else "x" for k in S.LOT_KEYS)
    polls = spark.createDataFrame([lot], keys)
    audit = spark.createDataFrame([(*lot, "auto_review", "r")], keys + ", scope_status string, scope_reason string")
    override = spark.createDataFrame([(*lot, "approved", "r", "e")] * 2, keys + ", override_status string, reason string, evidence string")
    with pytest.raises(Exception, match="duplicate keys in overrides"):
        S.effective_scope(polls, audit, override).collect()
