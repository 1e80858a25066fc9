"""Purged CV folds and k calibration (reference tests + invariants)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skewline.config import DEFAULT
from skewline.operators import cv
from skewline.operators import targets as TG


def _dates(spark, n):
    d = pd.bdate_range("2024-01-01", periods=n).date
    return spark.createDataFrame([(x,) for x in d], "date date")


def test_three_folds_over_100_business_days(spark):
    folds = cv.fold_ids(_dates(spark, 100), 3)
    roles = cv.purged_folds(folds, DEFAULT, horizon=5, embargo=2, n_splits=3).cache()
    for k in range(3):
        test = {r.date for r in roles.where((F.col("fold") == k) & (F.col("role") == "test")).collect()}
        train = {r.date for r in roles.where((F.col("fold") == k) & (F.col("role") == "train")).collect()}
        assert test and not (test & train)
        lo, hi = min(test), max(test)
        for d in train:  # purge and embargo distances hold for every training date
            assert abs((d - lo).days) >= 5 and abs((d - hi).days) >= 5
            assert not (lo - pd.Timedelta(days=2).to_pytimedelta() <= d < lo)
            assert not (hi < d <= hi + pd.Timedelta(days=2).to_pytimedelta())


def test_fewer_dates_than_folds(spark):
    folds = cv.fold_ids(_dates(spark, 3), 5).orderBy("date").collect()
    assert [r.fold for r in folds] == [0, 1, 2]


def test_calibrate_k_in_range_and_matches_bruteforce(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0, 0.02, 500)
    df = spark.createDataFrame([("A", float(v), 0.02) for v in r], "ticker string, fwd_ret double, sigma double")
    k = TG.calibrate_k(df, DEFAULT).collect()[0]["k"]
    assert 0.5 <= k <= 3.0
    exp = 1.5
    for g in np.linspace(0.5, 3.0, 50):
        if abs(np.mean(np.abs(r) > g * 0.02) - 0.30) < 0.05:
            exp = float(g)
            break
    assert k == exp


def test_calibrate_k_default_below_50_rows(spark):
    df = spark.createDataFrame([("A", 0.01, 0.02)] * 49, "ticker string, fwd_ret double, sigma double")
    assert TG.calibrate_k(df, DEFAULT).collect()[0]["k"] == 1.5
