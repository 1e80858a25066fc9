"""Pricing: the reference's scalar assertions plus round-trip and CDF accuracy."""

import math

import numpy as np
from pyspark.sql import functions as F

from skewline.functions import bsm


def iv(price, S=100.0, K=100.0, T=0.25, r=0.05, call=True):
    return bsm.np_implied_vol([price], [S], [K], [T], [r], [call])[0]


def test_atm_call_iv_in_range():
    v = iv(10.0)
    assert 0.01 < v < 2.0


def test_arbitrage_and_zero_price_give_null():
    assert math.isnan(iv(150.0))  # call price above spot
    assert math.isnan(iv(0.0))
    assert math.isnan(iv(120.0, call=False))  # put price above strike


def test_iv_round_trip_price():
    rng = np.random.default_rng(7)
    n = 2000
    S, K = rng.uniform(80, 120, n), rng.uniform(80, 120, n)
    T, r = rng.uniform(0.05, 1.0, n), rng.uniform(0.0, 0.05, n)
    sig = rng.uniform(0.05, 1.5, n)
    call = rng.random(n) < 0.5
    price = bsm.np_bsm_price(S, K, T, r, sig, call)
    got = bsm.np_implied_vol(price, S, K, T, r, call)
    ok = ~np.isnan(got)
    assert ok.mean() > 0.95
    back = bsm.np_bsm_price(S[ok], K[ok], T[ok], r[ok], got[ok], call[ok])
    assert np.max(np.abs(back - price[ok])) < 1e-9


def test_norm_cdf_accuracy():
    xs = np.linspace(-37, 37, 20001)
    ref = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs])
    assert np.max(np.abs(bsm.np_norm_cdf(xs) - ref)) < 1e-15


def test_delta_gamma_columns(spark):
    df = spark.createDataFrame([(100.0, 100.0, 0.5, 0.05, 0.3, "call"), (100.0, 100.0, 0.5, 0.05, 0.3, "put")],
                               "S double, K double, T double, r double, sig double, flag string")
    c = [F.col(x) for x in ("S", "K", "T", "r", "sig")]
    rows = df.select(bsm.bsm_delta(*c, F.col("flag")).alias("d"), bsm.bsm_gamma(*c).alias("g")).collect()
    assert 0.4 < rows[0]["d"] < 0.7
    assert rows[1]["d"] < 0
    assert abs(rows[0]["d"] - rows[1]["d"] - 1.0) < 1e-12
    assert rows[0]["g"] > 0


def test_iv_udf_in_spark(spark):
    df = spark.createDataFrame([(10.0, 100.0, 100.0, 0.25, 0.05, "call"), (150.0, 100.0, 100.0, 0.25, 0.05, "call"),
                                (None, 100.0, 100.0, 0.25, 0.05, "put")],
                               "p double, S double, K double, T double, r double, flag string")
    out = df.select(bsm.implied_vol(*[F.col(x) for x in ("p", "S", "K", "T", "r", "flag")]).alias("iv")).collect()
    assert 0.01 < out[0]["iv"] < 2.0
    assert out[1]["iv"] is None and out[2]["iv"] is None
