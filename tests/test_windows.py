"""Rolling windows against pandas (the reference's own computations)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skewline.operators import rolling as R


def _series(n=400, seed=3, holes=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.02, n)
    if holes:
        x[rng.random(n) < 0.05] = np.nan
    x[7] = x[9]  # a tie
    return x


def _frame(spark, x, ticker="A"):
    dates = pd.date_range("2020-01-01", periods=len(x), freq="D").date
    rows = [(d, ticker, None if np.isnan(v) else float(v)) for d, v in zip(dates, x)]
    return spark.createDataFrame(rows, "date date, ticker string, x double")


def _collect(df, col):
    return np.array([np.nan if r[col] is None else r[col] for r in df.orderBy("date").collect()])


def test_realized_vol_matches_pandas(spark):
    x = _series()
    got = _collect(_frame(spark, x).select("date", R.realized_vol(F.col("x"), R.wspec(), 20, 252).alias("v")), "v")
    exp = (pd.Series(x).rolling(20).std() * np.sqrt(252)).to_numpy()
    assert np.array_equal(np.isnan(got), np.isnan(exp))
    assert np.nanmax(np.abs(got - exp)) < 1e-12


def test_ewm_var_matches_pandas(spark):
    for lam, n in ((0.94, 1700), (0.5, 1700), (0.55, 1700), (0.99, 4000), (0.999, 10_000)):
        x = _series(n=n)
        x[700:760] = np.nan if lam > 0.9 else x[700:760]  # a gap over a block's end
        got = _collect(R.ewm_var(_frame(spark, x), "x", "v", lam), "v")
        exp = pd.Series(x).ewm(alpha=1 - lam).var().to_numpy()
        assert np.array_equal(np.isnan(got), np.isnan(exp)), lam
        assert np.nanmax(np.abs(got - exp) / np.nanmax(np.abs(exp))) < 1e-9, lam


def test_rolling_z_matches_pandas(spark):
    x = _series()
    got = _collect(_frame(spark, x).select("date", R.rolling_z(F.col("x"), R.wspec(), 252, 60).alias("z")), "z")
    s = pd.Series(x)
    exp = ((s - s.rolling(252, min_periods=60).mean()) / s.rolling(252, min_periods=60).std().replace(0, np.nan))
    exp = exp.to_numpy()
    assert np.array_equal(np.isnan(got), np.isnan(exp))
    assert np.nanmax(np.abs(got - exp)) < 1e-9


def test_pct_rank_matches_pandas(spark):
    x = np.round(_series(), 3)  # many ties
    got = _collect(_frame(spark, x).select("date", R.rolling_pct_rank(F.col("x"), R.wspec(), 252, 60).alias("p")), "p")

    # From the definition: among the values of the window, those below and half of those equal.
    exp = np.full(len(x), np.nan)
    for i, own in enumerate(x):
        window = x[max(0, i - 251):i + 1]
        window = window[~np.isnan(window)]
        if not np.isnan(own) and len(window) >= 60:
            exp[i] = (np.sum(window < own) + (np.sum(window == own) + 1) / 2) / len(window)
    assert np.array_equal(np.isnan(got), np.isnan(exp))
    assert np.nanmax(np.abs(got - exp)) < 1e-12


def test_prefix_sum_rolling_z_matches_pandas(spark):
    for seed in (3, 4):
        x = _series(n=900, seed=seed) + 5.0  # offset mean: exercises the centring
        got = _collect(R.with_rolling_z(_frame(spark, x), "x", "z", window=252, min_periods=60), "z")
        s = pd.Series(x)
        exp = ((s - s.rolling(252, min_periods=60).mean()) / s.rolling(252, min_periods=60).std()).to_numpy()
        assert np.array_equal(np.isnan(got), np.isnan(exp))
        assert np.nanmax(np.abs(got - exp)) < 1e-9


def test_prefix_sum_rolling_z_constant_window_is_null(spark):
    x = np.r_[np.full(100, 2.5), np.linspace(0, 1, 50)]
    got = _collect(R.with_rolling_z(_frame(spark, x), "x", "z", window=80, min_periods=60), "z")
    assert np.isnan(got[:100]).all() and not np.isnan(got[-1])


def _pandas_z(x, window=252, least=60):
    r = pd.Series(x).rolling(window, min_periods=least)
    lo, hi = r.min(), r.max()
    return np.where(lo == hi, np.nan, (pd.Series(x) - r.mean()) / r.std())


def test_rolling_z_forgets_level_shifts(spark):
    rng = np.random.default_rng(9)
    shift = np.r_[1e5, 1 + 0.3 * rng.random(699)]
    steps = np.r_[rng.random(300), 1e6 + rng.random(300), rng.random(600)]
    holes = np.where(rng.random(10_000) < 0.3, np.nan, rng.normal(5, 1e-3, 10_000))
    for x in (shift, steps, holes):
        got = _collect(R.with_rolling_z(_frame(spark, x), "x", "z"), "z")
        # Two-pass sums over every window: free of pandas' own running-sum drift.
        exp = np.full(len(x), np.nan)
        for i in range(len(x)):
            w = x[max(0, i - 251):i + 1]
            w = w[~np.isnan(w)]
            if len(w) >= 60 and not np.isnan(x[i]) and w.min() < w.max():
                exp[i] = (x[i] - w.mean()) / w.std(ddof=1)
        assert np.array_equal(np.isnan(got), np.isnan(exp))
        assert np.nanmax(np.abs(got - exp)) < 1e-7


def test_rolling_z_constant_stretches_and_nan(spark):
    x = np.r_[np.full(300, 0.1), np.linspace(0, 1, 200), np.full(400, 0.7)]
    df = _frame(spark, x).union(spark.createDataFrame([("2031-01-01", "A", float("nan"))], "d string, ticker string, x double")
                                .select(F.to_date("d"), "ticker", "x"))
    got = _collect(R.with_rolling_z(df, "x", "z", window=100, min_periods=60), "z")
    exp = _pandas_z(x, 100)
    assert np.array_equal(np.isnan(got[:-1]), np.isnan(exp)) and np.isnan(got[-1])
    assert np.nanmax(np.abs(got[:-1] - exp)) < 1e-6
