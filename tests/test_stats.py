"""AUC, KS and thresholds against brute force."""

import numpy as np
from pyspark.sql import functions as F

from skewline.operators import stats as ST


def _brute_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_auc_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.random(300), 2)
    y = (rng.random(300) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    got = ST.auc(df, "score", "label").collect()[0]["auc"]
    assert abs(got - _brute_auc(s, y)) < 1e-12


def test_auc_perfect_score(spark):
    df = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)], "score double, label int")
    assert ST.auc(df, "score", "label").collect()[0]["auc"] == 1.0


def test_ks_identical_samples_is_zero_and_matches_bruteforce(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(0, 1, 200), 1), np.round(rng.normal(0.3, 1, 150), 1)
    rows = [(0, float(v)) for v in a] + [(1, float(v)) for v in b]
    df = spark.createDataFrame(rows, "side int, x double")
    got = ST.ks_two_sample(df, ["x"], F.col("side")).collect()[0]["ks"]
    grid = np.union1d(a, b)
    exp = max(abs(np.mean(a <= g) - np.mean(b <= g)) for g in grid)
    assert abs(got - exp) < 1e-12
    same = spark.createDataFrame([(0, float(v)) for v in a] + [(1, float(v)) for v in a], "side int, x double")
    assert ST.ks_two_sample(same, ["x"], F.col("side")).collect()[0]["ks"] == 0.0


def test_bootstrap_of_a_binary_mean_has_the_normal_width(spark):
    rng = np.random.default_rng(3)
    v = (rng.random(400) < 0.6).astype(float)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id int, hit double")
    r = ST.bootstrap_ci(df, "hit", ["id"], n_boot=400).collect()[0]
    half = 1.2816 * v.std() / np.sqrt(len(v))
    assert abs(r["point"] - v.mean()) < 1e-12
    assert abs((r["hi"] - r["lo"]) / (2 * half) - 1) < 0.25 and r["lo"] < v.mean() < r["hi"]


def test_bootstrap_of_a_median_and_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], float(x)) for i, x in enumerate(rng.gamma(2, size=300))]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    for r in ST.bootstrap_ci(df, "x", ["id"], ["g"], stat=F.median, n_boot=200).collect():
        own = np.array([x for _, g, x in rows if g == r["g"]])
        assert abs(r["point"] - np.median(own)) < 1e-12 and r["lo"] < r["point"] < r["hi"]
        draws = np.median(rng.choice(own, (2000, len(own))), 1)
        assert abs(r["lo"] - np.quantile(draws, 0.1)) < 0.15 and abs(r["hi"] - np.quantile(draws, 0.9)) < 0.15


def test_poisson_thresholds_are_not_cut():
    t = ST.poisson_thresholds()
    assert len(t) > 15 and abs(t[0] - np.exp(-1)) < 1e-15 and all(a < b for a, b in zip(t, t[1:])) and 1 - t[-1] < 1e-15


def test_ordered_prefix_with_outliers_and_groups_of_different_size(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x), 1) for x in np.append(rng.random(5000) * 0.02, 1e6)] + [("b", float(x), 2) for x in rng.normal(1e9, 1, 40)] + [(None, 1.0, 3)]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    for inclusive in (True, False):
        got = ST.ordered_prefix(df, ["g"], "x", ["n"], inclusive).collect()
        assert len(got) == len(rows)
        for g in ("a", "b", None):
            own = sorted((r.x, r.n, r.cum_n) for r in got if r.g == g)
            total = 0
            for _, n, cum in own:
                assert cum == total + n * inclusive
                total += n
    assert {r.cum_n for r in ST.ordered_prefix(df.where("g = 'b'").drop("g"), [], "x", ["n"], True).collect()} == set(range(2, 82, 2))


def test_exact_percentiles_of_skewed_and_tied_values(spark):
    rng = np.random.default_rng(12)
    for values in ([5.0] * 700 + rng.exponential(size=301).tolist(), rng.integers(0, 4, 500).astype(float).tolist(), [2.5], (10.0 ** rng.normal(size=999)).tolist()):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
        got = ST.exact_percentiles(df, "v", [0.0, 0.33, 0.5, 0.67, 1.0]).first().q
        assert np.allclose(got, np.quantile(values, [0.0, 0.33, 0.5, 0.67, 1.0]), rtol=1e-12)
    assert ST.exact_percentiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]).first().q is None
