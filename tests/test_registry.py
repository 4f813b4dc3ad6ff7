import sys
from pathlib import Path

import pytest

from hustings.registry import QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import compare, duck  # noqa: E402

#: Operators of the blueprint: family and highest number.
FAMILIES = {"IO": 12, "CL": 27, "DT": 22, "SC": 20, "JN": 13, "AG": 35, "WN": 13, "TK": 5, "ST": 4, "RS": 4, "GV": 7, "ML": 16, "PR": 8, "QC": 9}
SAMPLE = [
    "rolling_in_chunks", "date_parse", "cutoff_excluded", "feature_block", "reliability_rank_in_buckets", "error_shape",
    "lot_audit", "scope_excluded_lots", "knn_similar_by_grid", "country_performance", "cleaned_observations", "csv_round_trip", "mixed_encodings", "stored_dataset_figures", "skip_reasons",
]


def test_every_operator_is_registered():
    covered = {i for q in QUERIES.values() for i in q.ids}
    wanted = {f"{family}{n}" for family, top in FAMILIES.items() for n in range(1, top + 1)}
    assert wanted - covered == set()


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf, name):
    assert compare(QUERIES[name].run(spark, sf), duck(sf), QUERIES[name].sql) == []


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["country", "election_year", "actual_winner", "predicted_winner", "winner_correct"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_keep_off_cross_joins_and_python(spark, sf):
    for name in ("rolling_mean_5", "feature_block", "lot_audit", "date_parse", "observation_errors"):
        plan = QUERIES[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
