import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from hustings.operators import ordering as O
from hustings.operators.quantiles import box_summary, grouped_quantiles, histogram


@pytest.mark.parametrize("buckets", [1, 16, 256])
def test_global_rank(spark, buckets):
    rnd = random.Random(3)
    data = [(rnd.choice([None, 0.5, 1.5, rnd.random()]), i) for i in range(500)]
    df = spark.createDataFrame(data, "v double, id int")
    got = {r.id: r["rank"] for r in O.global_rank(df, "v", ["id"], buckets=buckets).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), 1)}


def test_global_rank_of_nulls_only_and_of_nothing(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)], "v double, id int")
    assert {r.id: r["rank"] for r in O.global_rank(df, "v", ["id"]).collect()} == {i: i + 1 for i in range(5)}
    assert O.global_rank(df.where("false"), "v", ["id"]).count() == 0


def test_one_score_ranks_in_many_ranges(spark):
    df = spark.range(20_000).selectExpr("1.5 AS v", "id * 7919 % 20011 AS id")
    ranged = O.ordered_ranges(df, [F.col("v"), F.col("id")], 16)
    sizes = [r["count"] for r in ranged.groupBy("_bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3000
    ids = [r.id for r in O.global_rank(df, "v", ["id"], buckets=16).orderBy("rank").collect()]
    assert ids == sorted(ids)


@pytest.mark.parametrize("buckets", [1, 16])
def test_running_total_counts_null_first(spark, buckets):
    data = [(None, 4)] + [(i * 0.5, i % 7) for i in range(200)]
    df = spark.createDataFrame(data, "v double, n int")
    got = {r.v: r.below for r in O.running_total_before(df, "v", "n", "below", buckets=buckets).collect()}
    total, want = 0, {}
    for v, n in data:
        want[v] = total
        total += n
    assert got == want


def test_quantiles_match_numpy(spark):
    rnd = random.Random(4)
    data = [("hot", rnd.choice([1.0, rnd.gauss(0, 5)])) for _ in range(4000)] + [("one", 2.5)] + [("two", 1.0), ("two", 4.0)]
    data += [(None, rnd.gauss(0, 1)) for _ in range(50)]
    df = spark.createDataFrame(data + [("hot", None)], "k string, v double")
    got = {r.k: r for r in box_summary(df, ["k"], "v").collect()}
    assert got.keys() == {"hot", "one", "two", None}
    for k in ("hot", "one", "two", None):
        v = np.array([x for g, x in data if g == k])
        for name, p in (("minimum", 0), ("q1", 25), ("median", 50), ("q3", 75), ("maximum", 100)):
            assert abs(got[k][name] - np.percentile(v, p)) < 1e-9
    overall = grouped_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert abs(overall - np.median([x for _, x in data])) < 1e-9


def test_quantiles_of_a_group_beyond_the_sketch(spark):
    df = spark.range(300_000).selectExpr("id % 2 AS k", "cast(id * 7919 % 300007 as double) AS v")
    got = {r.k: r for r in box_summary(df, ["k"], "v").collect()}
    for k in (0, 1):
        v = np.array([i * 7919 % 300007 for i in range(k, 300_000, 2)], float)
        assert [got[k][n] for n in ("minimum", "q1", "median", "q3", "maximum")] == pytest.approx([np.percentile(v, p) for p in (0, 25, 50, 75, 100)])


def joined_rows(plan):
    """Rows that each join of an executed plan has put out."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return joined_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return joined_rows(plan.plan())
    own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in kind else []
    return own + [n for i in range(plan.children().size()) for n in joined_rows(plan.children().apply(i))]


@pytest.mark.parametrize("distinct", [10, 200_000])
def test_quantiles_of_one_group_stay_divided(spark, distinct):
    df = spark.range(200_000).selectExpr("'one' AS k", f"cast(id * 7919 % {distinct} as double) AS v")
    found = grouped_quantiles(df, ["k"], "v", {"m": 0.5})
    assert found.collect()[0].m == pytest.approx(np.median([i * 7919 % distinct for i in range(200_000)]))
    sizes = joined_rows(found._jdf.queryExecution().executedPlan())
    assert sizes and max(sizes) < 150_000


def test_quantiles_skip_missing_values_and_keep_infinite_ones(spark):
    inf = float("inf")
    data = [("a", x) for x in (None, float("nan"), -inf, 0.0, -0.0, 1.0, inf)] + [("empty", None), (None, 2.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in grouped_quantiles(df, ["k"], "v", {"q": 0.375, "m": 0.5}).collect()}
    assert got.keys() == {"a", None}
    assert (got["a"].q, got["a"].m, got[None].q, got[None].m) == (0.0, 0.0, 2.0, 2.0)
    whole = spark.createDataFrame([(i,) for i in (4, 1, 1, 7)], "v int")
    assert grouped_quantiles(whole, [], "v", {"q": 0.75}).first().q == 4.75
    assert grouped_quantiles(whole.where("false"), [], "v", {"q": 0.75}).collect() == []


def test_histogram_covers_every_row(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    bins = histogram(df, "v", 24).collect()
    assert sum(b.n for b in bins) == 100 and max(b.bin for b in bins) == 23
    assert histogram(spark.createDataFrame([(3.0,)], "v double"), "v").collect() == [(0, 1)]


def test_ties_and_short_groups(spark):
    df = spark.createDataFrame([("a", "x", 5.0), ("a", "w", 5.0), ("b", "x", 1.0)], "g string, s string, v double")
    best = O.best_row(df, ["g"], [F.col("v").desc(), F.col("s")], ["s"])
    assert rows(best) == [("a", "w"), ("b", "x")]
    margins = {r.g: r.margin for r in O.top_two_margin(df, ["g"], "v", "s").collect()}
    assert margins == {"a": 0.0, "b": None}


def test_selection_and_ends(spark):
    df = spark.createDataFrame([(c, i > 3) for i, c in enumerate("abcdef")], "party string, inc boolean")
    assert rows(O.default_selection(df, "inc")) == [("e",), ("f",)]
    assert len(rows(O.default_selection(df.withColumn("inc", F.lit(False)), "inc"))) == 4
    v = spark.createDataFrame([(float(i), i) for i in range(30)], "v double, id int")
    ends = O.both_ends(v, "v", 2, ["id"]).collect()
    assert sorted((r.end, r.id) for r in ends) == [("highest", 28), ("highest", 29), ("lowest", 0), ("lowest", 1)]


@pytest.mark.parametrize("n", [1, 4])
def test_first_cells_of_each_column(spark, n):
    rnd = random.Random(n)
    data = [(rnd.choice(["a", "b", None]), i * 7919 % 5003, [rnd.choice([None, None, f"v{i}-{c}"]) for c in range(rnd.randint(0, 5))]) for i in range(3000)] + [("c", 1, None), ("d", 2, [None])]
    df = spark.createDataFrame(data, "k string, at long, cells array<string>").repartition(5)
    want = {}
    for k, at, cells in sorted(data, key=lambda r: r[1]):
        for c, v in enumerate(cells or []):
            if v is not None and len(want.setdefault((k, c), [])) < n:
                want[k, c].append((at, v))
    got = {}
    for r in O.first_cells(df, ["k"], "at", n=n).collect():
        got.setdefault((r.k, r.col_idx), []).append((r["at"], r.value))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert O.first_cells(df.where("at < 0"), ["k"], "at").count() == 0
