import pytest

from conftest import rows
from hustings.operators import rawtables as R
from hustings.sources.files import read_raw_rows

FILES = {
    "australia_2010_table0.csv": 'Date,Political parties,Political parties,Two-party-preferred,Two-party-preferred,Unnamed: 5_level_0\n'
    "Unnamed: 0_level_1,ALP,Grn,ALP,Lib/Nat,Unnamed: 5_level_1\nElection,38%,11.8%,50.1%,49.9%,\n"
    "17–19 Aug 2010,36.2%,13.7%,50.2%,49.8%,x\n13-15 Aug 2010,38%,12%,—,48%,\n",
    "canada_2004_table2.csv": 'Last day of survey,LPC,CPC,NDP,Polling firm,Sample\nLast day of survey,Unnamed: 1_level_1,Unnamed: 2_level_1,Unnamed: 3_level_1,Polling firm,Sample\n'
    'Voting results,36.7,29.6,15.7,,\n"June 25, 2004",34,31.9,18.8,"SES\nResearch",600\n"June 24, 2004",34,30,20,Ekos,500\n"June 23, 2004",33,30,20,Ekos,\n',
    "uk_1997_table1.csv": "Date,Area,Client,Con,Lab,Lead\n1 May 1997,GB,X,31,44,13\n2 May 1997,Scotland,X,20,50,30\n3 May 1997,GB,X,31,44,13\n3 May 1997,GB,X,31,44,13\n",
    "uk_1997_table2.csv": "Date,Pollster,Con,Seats\n1 May 1997,a,31,300\n2 May 1997,a,31,300\n3 May 1997,a,31,300\n",
    "uk_1997_table3.csv": "Date,Con,Lab\n1 May 1997,1,2\n2 May 1997,1,2\n3 May 1997,1,2\n",
    "uk_1997_table4.csv": "Who,Con,Lab,Lead\nalpha,31,44,1\nbeta,31,44,1\ngamma,31,44,1\n",
    "uk_1997_table5.csv": "Date,Con,Tony Blair,Lead\n1 May 1997,31,44,1\n2 May 1997,31,44,1\n3 May 1997,31,44,1\n",
    "uk_1997_table6.csv": "Date,Area,Con,Lab\n1 May 1997,Wales,31,44\n2 May 1997,Wales,31,44\n3 May 1997,Wales,31,44\n",
    "notes.csv": "a,b\n1,2\n",
}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    return read_raw_rows(spark, str(folder), 20, multi_line=True)


def test_lines_keep_order_width_and_quotes(raw):
    got = {(r.source_table, r.row_idx): r for r in raw.collect()}
    assert ("notes.csv", 0) not in got
    quoted = got[("canada_2004_table2.csv", 3)]
    assert quoted.cells == ["June 25, 2004", "34", "31.9", "18.8", "SES\nResearch", "600"]
    assert (quoted.country, quoted.election_year) == ("canada", 2004)
    assert len(got[("uk_1997_table3.csv", 0)].cells) == 3


def test_decisions_and_observations(spark, raw):
    observations, decided = R.clean_tables(raw, R.label_table(spark))
    assert {r.source_table: r.status for r in decided.collect()} == {
        "australia_2010_table0.csv": "ok", "canada_2004_table2.csv": "ok", "uk_1997_table1.csv": "ok",
        "uk_1997_table2.csv": R.SEATS, "uk_1997_table3.csv": R.TOO_SMALL, "uk_1997_table4.csv": R.NO_DATES,
        "uk_1997_table5.csv": "fewer than 2 recognised party columns found (got 1)", "uk_1997_table6.csv": R.NO_NATIONAL,
    }
    by = {}
    for r in observations.collect():
        by.setdefault(r.source_table, []).append(r)
    australia = {(r.date_raw, r.party): r.pct for r in by["australia_2010_table0.csv"]}
    assert australia[("17–19 Aug 2010", "ALP (Primary)")] == 36.2 and australia[("17–19 Aug 2010", "ALP (2PP)")] == 50.2
    assert ("13-15 Aug 2010", "ALP (2PP)") not in australia and australia[("13-15 Aug 2010", "L/NP (2PP)")] == 48.0
    canada = [r for r in by["canada_2004_table2.csv"] if r.date_raw == "June 25, 2004"]
    assert {r.party for r in canada} == {"LPC", "CPC", "NDP"} and canada[0].sample_size == "600"
    assert len(by["uk_1997_table1.csv"]) == 4  # one area dropped, one exact copy removed
    assert sum(r.tables for r in R.skip_report(decided).collect()) == 8


def test_scrape_admission(raw):
    got = {r.source_table: r.admitted for r in R.admissible_scrape(raw).collect()}
    assert got["uk_1997_table3.csv"] and not got.get("missing", False)


def test_scrape_without_digits_is_rejected(spark):
    lines = {"few_digits": [["a 1", "x"], ["b", "y"], ["c", "z"], ["d", "4"]], "short": [["1", "2"]], "numbers": [["1", "2"], ["3", "n"], ["5", None]]}
    rows = [(t, "uk", 1997, i, cells) for t, own in lines.items() for i, cells in enumerate([["h", "k"], *own])]
    raw = spark.createDataFrame(rows, "source_table string, country string, election_year int, row_idx bigint, cells array<string>")
    assert {r.source_table: r.admitted for r in R.admissible_scrape(raw).collect()} == {"few_digits": False, "short": False, "numbers": True}


def test_repeated_headers(spark):
    df = spark.createDataFrame([(["X", "Y", "X", None, "X"],)], "h array<string>")
    assert df.select(R.header_names(df.h)).first()[0] == ["X", "Y", "X.1", "Unnamed: 3", "X.2"]


def test_labels(spark):
    df = spark.createDataFrame([("uk", "Con[a]"), ("uk", "lib dem (2PP)"), ("uk", "Zed.1"), ("australia", "Coalition (Primary)")], "country string, name string")
    assert rows(R.canonical_labels(df, R.label_table(spark), "name", "party"), "name", "party") == [
        ("Coalition (Primary)", "L/NP (Primary)"), ("Con[a]", "CON"), ("Zed.1", "ZED"), ("lib dem (2PP)", "LD (2PP)"),
    ]
