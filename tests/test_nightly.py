"""Nights from stored state give the features of the full history."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewline.config import DEFAULT
from skewline.operators import nightly as N
from skewline.operators.features import FEATURE_COLUMNS, features_daily
from skewline.session import materialize

# Short windows, so that a small history fills them.
CFG = DEFAULT.with_(rolling_window=40, rolling_min_periods=12)
DAY = dt.timedelta(1)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    bars, options, market = [], [], []
    close = {t: 100.0 for t in "ABCD"}
    for i in range(130):
        day = dt.date(2024, 1, 1) + DAY * i
        market.append((day, 15 + 5 * float(rng.random()), 16.0, None if i % 7 == 0 else float(rng.random()), 0.03, 18.0, 40.0))
        for t in close:
            if t == "D" and i < 90 or t == "C" and 50 < i < 70:  # a ticker listed late, one with a gap
                continue
            if rng.random() < 0.93:
                close[t] *= float(np.exp(rng.normal(0, 0.02)))
                bars.append((day, t, close[t] * 0.999, close[t]))
            if rng.random() < 0.95:
                for k, kind in ((0.95, "put"), (1.0, "call"), (1.0, "put"), (1.05, "call")):
                    for days in (30, 60):
                        strike = round(close[t] * k, 1)
                        px = max(0.5, abs(close[t] - strike)) + 2 + float(rng.random())
                        options.append((day, f"O:{t}{k}{kind}{days}{i}", t, strike, day + DAY * days, kind, px, px * 1.01, float(rng.integers(1, 90)), 20))
    return (spark.createDataFrame(options, "date date, ticker string, underlying string, strike double, expiry date, contract_type string, "
                                           "open double, close double, volume double, transactions int").cache(),
            spark.createDataFrame(bars, "date date, ticker string, open double, close double").cache(),
            spark.createDataFrame(market, "date date, vix double, vix3m double, hy_oas double, t_bill_3m double, dspx double, cor1m double").cache())


def rows(df):
    return {(r.date, r.ticker): [r[c] for c in FEATURE_COLUMNS] for r in df.collect()}


def same(a, b):
    assert set(a) == set(b)
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-8 * max(1, abs(x))), k


def between(tables, lo, hi):
    return [t.where((F.col("date") >= F.lit(lo)) & (F.col("date") <= F.lit(hi))) for t in tables]


@pytest.fixture
def few_partitions(spark):
    """Small nights: many jobs of a few rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_thirty_nights_in_a_row_equal_the_full_run(spark, tables, few_partitions):
    options, bars, market = tables
    want = rows(features_daily(options, bars, market, CFG))
    start = dt.date(2024, 1, 1) + DAY * 100
    o, b, _ = between(tables, dt.date(2024, 1, 1), start - DAY)
    feats, state = N.night(o, b, market.where(F.col("date") < F.lit(start)), N.empty_state(spark), CFG)
    got = rows(feats)
    same({k: v for k, v in want.items() if k[0] < start}, got)
    state = materialize(state, "state")
    for i in range(30):
        day = start + DAY * i
        o, b, _ = between(tables, day, day)
        feats, after = N.night(o, b, market.where(F.col("date") <= F.lit(day)), state, CFG)
        got |= rows(feats)
        state = materialize(after, "state")
    same(want, got)
    # One bounded row a ticker.
    for r in state.collect():
        assert len(r.bars) <= N.bars_kept(CFG) and len(r.features) < CFG.rolling_window
        assert r.depth == bars.where(F.col("ticker") == r.ticker).count()


def test_a_range_of_nights_at_once(spark, tables):
    options, bars, market = tables
    want = rows(features_daily(options, bars, market, CFG))
    state, got = N.empty_state(spark), {}
    for lo, hi in ((0, 19), (20, 79), (80, 80), (81, 129)):
        lo, hi = (dt.date(2024, 1, 1) + DAY * d for d in (lo, hi))
        o, b, _ = between(tables, lo, hi)
        feats, state = N.night(o, b, market.where(F.col("date") <= F.lit(hi)), state, CFG)
        got |= rows(feats)
        state = materialize(state, "state")
    same(want, got)


def test_a_night_reads_only_its_own_bars(spark, tables):
    """The plan of a night scans the night's tables and the state, nothing older."""
    options, bars, market = tables
    day = dt.date(2024, 4, 20)
    o, b, _ = between(tables, dt.date(2024, 1, 1), day - DAY)
    _, state = N.night(o, b, market.where(F.col("date") < F.lit(day)), N.empty_state(spark), CFG)
    state = materialize(state, "state")
    o, b, _ = (materialize(t, "tonight") for t in between(tables, day, day))
    feats, after = N.night(o, b, materialize(market, "market"), state, CFG)
    for df in (feats, after):
        scans = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in line or "LocalRelation" in line or "InMemory" in line]
        assert scans and not any("InMemory" in s or "ExistingRDD" in s for s in scans)
    assert feats.select("date").distinct().collect() == [(day,)]
