import json

import pytest
from pyspark.errors import AnalysisException

from conftest import rows
from hustings.operators.models import metric_rows
from hustings.operators.results import DISTRICT_SERIES, candidate_averages, map_names, present_column_share, weighted_share
from hustings.operators.quality import QualityError
from hustings.sources import files, sinks
from pyspark.sql import functions as F


def test_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,v\nCôté – x,1\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("name,v\nCôté – y,2\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("name,v\nCôt\x81é,3\n".encode("latin-1"))
    found = {r.path[-5:]: r.encoding for r in files.file_encodings(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": "utf-8", "b.csv": "windows-1252", "c.csv": "iso-8859-1"}
    assert rows(files.read_csv_any_encoding(spark, str(tmp_path))) == sorted([("Côté – x", "1"), ("Côté – y", "2"), ("Côt\x81é", "3")], key=str)


def test_lines_of_many_headers_quotes_and_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffname , v\r\n\"x, \"\"y\"\"\",1\r\n\r\nß,\r\n".encode())
    (tmp_path / "b.csv").write_bytes("v,w\n2,é\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b"v,w\n")
    out = files.read_csv_any_encoding(spark, str(tmp_path))
    assert rows(out, "name", "v", "w") == sorted([('x, "y"', "1", None), ("ß", None, None), (None, "2", "é")], key=str)
    with pytest.raises(files.SourceError, match="different headers"):
        files.read_csv_any_encoding(spark, str(tmp_path), most_headers=1)


def test_a_file_is_split_among_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"k,v\n" + b"".join(b"%d,caf\xe9\n" % i for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        out = files.read_csv_any_encoding(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert out.count() == 20_000 and rows(out.select("v").distinct()) == [("café",)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bom_strict_types_and_missing_columns(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_bytes("﻿country,election_year,extra\nuk,2010.0,q\n".encode("utf-8"))
    df = files.read_csv(spark, str(path), "country string, election_year int")
    assert df.collect() == [("uk", 2010)]
    with pytest.raises(files.SourceError):
        files.read_csv(spark, str(path), "country string, absent int")
    with pytest.raises(AnalysisException):
        files.read_csv(spark, str(tmp_path / "none.csv"), "country string")
    path.write_text("country,election_year\nuk,never\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(path), "country string, election_year int").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b", 2.0, "x")], "k string, v double, n string")
    assert rows(sinks.fixed_decimals(df), "k", "v") == [("a", "1.500000"), ("b", "2.000000")]
    assert json.loads(sinks.json_records(df.where("k = 'a'")).first()[0]) == {"k": "a", "v": 1.5, "n": None}
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"), ["k"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    manifest = sinks.dataset_manifest({"x.json": ("x.csv", df)}).first()
    assert (manifest["rows"], manifest["columns"]) == (2, "k,v,n")
    sinks.write_once(df, str(tmp_path / "once"))
    with pytest.raises(AnalysisException):
        sinks.write_once(df, str(tmp_path / "once"))


def test_decision_uses_measured_figures(spark, tmp_path):
    value = spark.createDataFrame([(1.25,)], "value double")
    metrics = metric_rows([("t", "m", "MAE", value), ("t", "other", "MAE", value.select((F.col("value") * 2).alias("value")))])
    record = sinks.decision_record(metrics, "m", "c", "basis", "no", "once")
    sinks.write_decision(record, str(tmp_path / "decision"))
    assert json.loads(spark.read.text(str(tmp_path / "decision")).first()[0])["development_mae"] == 1.25


def test_outcomes(spark):
    votes = spark.createDataFrame([(2019, "10", "-", "30"), (2019, "5", "5", "20"), (2017, "1", "1", "0")], "election int, con string, lab string, total string")
    got = rows(weighted_share(votes, "election", {"CON": "con", "LAB": "lab", "LIB": "lib"}, "total", F.lit("uk")))
    assert got == [("uk", 2019, "CON", 30.0), ("uk", 2019, "LAB", 10.0)]
    districts = spark.createDataFrame([(2004, 3, 1, 0), (2004, None, 4, 2)], "y int, ConParty int, Lib int, Other int")
    assert rows(present_column_share(districts, "y", F.lit("canada")), "party", "actual_pct") == [("CPC", 30.0), ("LPC", 50.0), ("OTHER", 20.0)]
    with pytest.raises(QualityError):
        present_column_share(districts.withColumn("Con", F.lit(1)), "y", F.lit("canada"), DISTRICT_SERIES)


def test_names_and_averages(spark):
    df = spark.createDataFrame([("Donald Trump",), ("Trump",), ("Jeb Bush",), ("Ross Perot",), (None,)], "candidate_name string")
    assert rows(map_names(df, "candidate_name", "party"), "candidate_name", "party") == sorted(
        [("Donald Trump", "REP"), ("Trump", "REP"), ("Jeb Bush", "REP"), ("Ross Perot", "OTHER"), (None, "OTHER")], key=str
    )
    raw = spark.createDataFrame([(2016, "National", "11/1/2016", "Trump", 44.0), (2016, "Ohio", "11/1/2016", "Trump", 50.0)], "cycle int, state string, modeldate string, candidate_name string, pct_estimate double")
    out = candidate_averages(raw, "us", "f.csv").collect()
    assert len(out) == 1 and out[0].party == "REP" and out[0].pollster is None


def test_wide_raw_file_is_an_error(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir(), bad.mkdir()
    (good / "uk_1997_table1.csv").write_text('a,"b,c,d,e",f\n1,2\n')
    (bad / "uk_1997_table1.csv").write_text("a,b,c,d,e\n1,2,3,,5\n")
    assert sorted((r.cells for r in files.read_raw_rows(spark, str(good), 3).collect()), reverse=True) == [["a", "b,c,d,e", "f"], ["1", "2", None]]
    with pytest.raises(Exception, match="more columns than max_columns"):
        files.read_raw_rows(spark, str(bad), 3).collect()


def test_whole_numbers_are_read_strictly(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a,b\n2010.0,9007199254740993\n")
    assert files.read_csv(spark, str(path), "a int, b bigint").first() == (2010, 9007199254740993)
    path.write_text("a,b\n2010.7,1\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(path), "a int, b bigint").collect()
