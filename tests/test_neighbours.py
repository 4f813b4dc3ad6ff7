import random

import numpy as np
import pytest

from hustings.operators.neighbours import VECTOR, _box_search, median_cuts, nearest_neighbours

# Published vectors and their three nearest cycles with distances.
VECTORS = """australia,2010,51.24,2.785253061282693,0.23999999999999488,65
australia,2013,53.0,0.9949874371066205,6.980000000000004,11
australia,2016,50.6,2.681807833154392,0.7199999999999989,225
australia,2019,48.6,1.4237716988127471,3.0600000000000023,196
australia,2022,51.46,3.625391411818714,4.260000000000005,126
canada,2004,33.52,2.726653814777561,7.0972587529014675,40
canada,2006,36.94,4.161309733082312,6.0379725965011275,202
canada,2008,36.32,2.658434841828876,11.39114146338078,300
canada,2015,38.48,3.5329001792553894,7.556526834485897,115
canada,2019,32.260000000000005,1.8886395349724592,1.3399019712621367,118
uk,1997,45.84,3.2367313173822,12.552088320875693,83
uk,2001,43.94,3.271535286940416,8.978281993324867,58
uk,2005,37.24,1.9854901290692883,2.8230160506343225,96
uk,2010,36.38,2.507501314948477,7.0640156746903635,173
uk,2015,35.160000000000004,1.7926422409145197,6.359913380639004,232
uk,2017,42.6,2.8892206021666977,2.356110001110409,129
uk,2019,43.66,7.186326108314945,11.54929185912087,256
us,2000,43.1830368,2.565099179552032,0.30932680669865675,251
us,2004,48.5291886,1.4236591616563439,2.427148878251849,251
us,2008,50.6827604,1.483016071244966,7.229864489451991,251
us,2012,47.8712722,0.8626438715957552,3.799233667533386,251
us,2016,45.799278,2.100946976461844,2.015067979377534,251"""
NEAREST = {
    ("australia", 2010): [("australia", 2022, 1.4715600107574724), ("uk", 2017, 1.6585947918432027), ("australia", 2016, 1.923262946859234)],
    ("canada", 2019): [("uk", 2005, 0.9195296148379287), ("uk", 2017, 1.8124342452046134), ("uk", 2010, 1.882726091308436)],
    ("uk", 2019): [("canada", 2006, 3.023389865171711), ("canada", 2015, 3.532243275417191), ("canada", 2008, 3.6783646035418047)],
    ("us", 2016): [("us", 2004, 0.6794266113753781), ("us", 2000, 0.7155928288266623), ("australia", 2019, 0.9868288230096203)],
}
KEYS = ["country", "election_year"]


@pytest.mark.parametrize("box_points", [None, 1, 8])
def test_published_pairs(spark, box_points):
    data = [(c, int(y), *map(float, v)) for c, y, *v in (line.split(",") for line in VECTORS.splitlines())]
    df = spark.createDataFrame(data, "country string, election_year int, " + ", ".join(f"{c} double" for c in VECTOR))
    out = nearest_neighbours(df, KEYS, k=3, box_points=box_points).collect()
    assert len(out) == 66
    for key, want in NEAREST.items():
        got = sorted((r.distance, r.similar_country, r.similar_election_year) for r in out if (r.country, r.election_year) == key)
        for (d, c, y), (wc, wy, wd) in zip(got, want):
            assert (c, y) == (wc, wy) and abs(d - wd) < 1e-9


@pytest.mark.parametrize("box_points", [None, 1, 8])
def test_copies_and_outliers(spark, box_points):
    rnd = random.Random(2)
    data = [("c", i, 1.0, 2.0, 7.0) for i in range(60)]  # a third of all rows are copies of one vector
    data += [("c", 100 + i, rnd.gauss(0, 1), rnd.gauss(0, 1), 7.0) for i in range(118)] + [("c", 900, 80.0, -60.0, 7.0), ("c", 901, 81.0, -60.0, 7.0)]
    df = spark.createDataFrame(data, "country string, election_year int, a double, b double, const double")
    out = nearest_neighbours(df, KEYS, ["a", "b", "const"], k=3, box_points=box_points).collect()
    v = np.array([r[2:] for r in data])
    sd = v.std(axis=0)
    sd[sd == 0] = 1
    z = (v - v.mean(axis=0)) / sd
    for i, row in enumerate(data):
        dist = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
        want = sorted((round(float(dist[j]), 9), data[j][1]) for j in range(len(data)) if j != i)[:3]
        got = sorted((round(r.distance, 9), r.similar_election_year) for r in out if r.election_year == row[1])
        assert got == want


def test_few_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "country string, election_year int, x double")
    assert len(nearest_neighbours(df, KEYS, ["x"], k=3).collect()) == 2
    assert nearest_neighbours(df.limit(1), KEYS, ["x"], k=3).collect() == []


@pytest.mark.parametrize("box_points", [None, 1, 16])
def test_equal_distances_on_a_cube_go_to_the_smaller_number(spark, box_points):
    names = [f"x{i}" for i in range(7)]  # each corner has seven nearest others
    data = [(37 * n % 128, *(1.0 if n >> i & 1 else -1.0 for i in range(7))) for n in range(128)]
    points = spark.createDataFrame(data, "pid long, " + ", ".join(f"{c} double" for c in names))
    found = {}
    for r in _box_search(points, names, 4, box_points).collect():
        found.setdefault(r.pid, []).append((r.distance, r._other))
    for n in range(128):
        pid = 37 * n % 128
        assert sorted(found[pid]) == [(0.0, pid)] + [(2.0, p) for p in sorted(37 * (n ^ 1 << i) % 128 for i in range(7))[:3]]


def test_boxes_hold_about_as_many_points_and_cover_all():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(4096, 3)) * [1, 5, 0.1]
    dim, value = median_cuts(points, 6)
    node = np.ones(len(points), int)
    for _ in range(6):
        node = 2 * node + (points[np.arange(len(points)), dim[node]] > value[node])
    assert np.bincount(node - 64, minlength=64).min() >= 60 and np.bincount(node - 64).max() <= 68
    dim, value = median_cuts(np.ones((50, 2)), 3)  # nothing to cut
    assert np.isinf(value).all()


def test_many_points_match_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(2500, 3)), 0.01 * rng.normal(size=(2500, 3)) + 4, rng.uniform(-50, 50, (40, 3))])
    df = spark.createDataFrame([("c", i, *map(float, v)) for i, v in enumerate(x)], "country string, election_year int, a double, b double, d double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = {}
    for r in nearest_neighbours(df, KEYS, ["a", "b", "d"], k=4).collect():
        got.setdefault(r.election_year, []).append((r.distance, r.similar_election_year))
    for i in range(0, len(z), 7):
        dist = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
        dist[i] = np.inf
        assert sorted(j for _, j in got[i]) == sorted(np.argsort(dist)[:4].tolist())
