import numpy as np
import pytest

from hustings.llm import neighbour_forest as N


def brute(rows, k=10, every=100):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float32).astype(np.float64)
    out = {}
    for i in sorted(set(ids[ids % every == 0].tolist())):
        gap = v - v[np.flatnonzero(ids == i)[0]]
        d = np.sqrt((gap * gap).sum(axis=1))
        other = np.flatnonzero(ids != i)
        out[i] = [(int(ids[j]), d[j]) for j in other[np.lexsort((ids[other], d[other]))[:k]]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, name):
    table = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = found(N.nearest(table))
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    exact = {(q, i): d for q in want for i, d in want[q]}
    assert all(exact.get((q, i), d) == d for q in got for i, d in got[q])


def test_structured_vectors_need_a_small_share(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16)) * 4
    rows = [(i, (centres[i % 60] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = brute(rows), found(N.nearest(table, share=0.1, leaves=128))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) > 0.9


def test_copies_ties_and_odd_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(300 + i, [float(i), 1.0, 0.0]) for i in range(1, 40)]
    bad = [(400, None), (500, [0.0, 0.0, 0.0]), (600, [1.0, None, 2.0]), (700, [1.0, float("nan"), 2.0]), (800, [float("inf"), 1.0, 1.0]), (900, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<float>").selectExpr("*", "1 AS tree", "2 AS leaf", "3 AS rank")
    assert found(N.nearest(table, share=100.0)) == brute(rows)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert found(N.nearest(few)) == {0: [(1, 1.0)]}
    assert N.nearest(table.where("false")).count() == 0
