"""Refits without look-ahead: parameters of every stamp, scoring by the latest stamp, drift at every date."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from skewline.config import DEFAULT as CFG
from skewline.operators import stats as ST
from skewline.operators import targets as TG
from skewline.operators import walkforward as WF
from skewline.operators.features import stock_panel
from skewline.plans import monitor as MO
from skewline.plans import queries_output as QO
from skewline.sources.fixtures import Fixtures

DAY = dt.timedelta(1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(3):
        close = 100.0
        for i in range(900):
            day = dt.date(2021, 1, 4) + DAY * i
            if day.weekday() < 5 and rng.random() > 0.03:
                close *= float(np.exp(rng.normal(0, 0.01 + 0.01 * t)))
                rows.append((day, f"T{t}", close * 0.999, close * 1.01, close * 0.98, close, 1000.0))
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double").cache()


def test_period_start(spark):
    rows = [(dt.date(2024, m, d),) for m in range(1, 13) for d in (1, 28)]
    got = spark.createDataFrame(rows, "date date").select("date", WF.period_start(F.col("date")).alias("q"),
                                                          WF.period_start(F.col("date"), CFG.with_(refit_frequency_months=1)).alias("m")).collect()
    for r in got:
        assert r.q == dt.date(2024, 3 * ((r.date.month - 1) // 3) + 1, 1) and r.m == r.date.replace(day=1)


def test_k_of_every_stamp_is_that_of_its_prefix(spark, bars):
    returns = TG.forward_returns(bars, CFG, known=True)
    by_stamp = WF.rows_by_stamp(returns, CFG)
    got = {(r.stamp, r.ticker): (r.k, r.n_valid) for r in WF.k_by_stamp(by_stamp, CFG).collect()}
    stamps = sorted({s for s, _ in got})
    assert len(stamps) > 5
    for stamp in stamps:
        # Everything as if the table ended the day before the stamp.
        prefix = TG.forward_returns(bars.where(F.col("date") < F.lit(stamp)), CFG)
        prefix = prefix.where(F.col("date") >= F.date_sub(F.lit(stamp), WF.window_days(CFG)))
        want = {(stamp, r.ticker): (r.k, r.n_valid) for r in TG.calibrate_k(prefix, CFG).collect()}
        assert {k: v for k, v in got.items() if k[0] == stamp} == want
    reg = {r.stamp: r for r in WF.registry(by_stamp).collect()}
    assert all(r.last_known < s and r.n_rows >= 200 for s, r in reg.items()) and set(reg) < set(stamps)


def test_dates_are_scored_by_the_latest_refit(spark):
    stamps = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 4, 1),)], "stamp date")
    dates = spark.createDataFrame([(dt.date(2023, 12, 31),), (dt.date(2024, 1, 1),), (dt.date(2024, 3, 31),), (dt.date(2024, 4, 1),), (dt.date(2024, 9, 9),)], "date date")
    got = {r.date: (r.stamp, r.next_refit) for r in WF.model_at(dates, stamps).collect()}
    first, second, third = dt.date(2024, 1, 1), dt.date(2024, 4, 1), dt.date(2024, 7, 1)
    assert got == {first: (first, second), dt.date(2024, 3, 31): (first, second), second: (second, third), dt.date(2024, 9, 9): (second, third)}


def test_later_rows_change_no_earlier_signal(spark):
    """Signals, thresholds and refits of dates up to a cut are the same when every table ends there."""
    fx = Fixtures(spark, SF01)
    days = sorted(r.date for r in fx.v_bars.select("date").distinct().collect())
    cut = days[int(len(days) * 0.7)]
    short = Fixtures(spark, SF01, store=False)
    for view in ("v_options", "v_bars", "v_market", "v_signals"):
        short._cache[view] = fx.view(view).where(F.col("date") <= F.lit(cut))
    short._cache["v_event_calendar"] = fx.v_event_calendar
    full, part = QO._scored(fx), QO._scored(short)
    cols = [c for c in full.signals.columns if c not in ("top_features", "leakage_caveats")]
    a, b = (sorted(map(tuple, x.signals.select(*cols).where(F.col("date") <= F.lit(cut)).collect())) for x in (full, part))
    assert a == b and len(a) > 0
    early = [tuple(r) for r in full.stamps.where(F.col("stamp") <= F.lit(cut)).orderBy("stamp").collect()]
    assert early == [tuple(r) for r in part.stamps.where(F.col("stamp") <= F.lit(cut)).orderBy("stamp").collect()] and early


def brute_ks(rows, end):
    recent = [v for d, v in rows if end - 60 * DAY <= d <= end]
    try:
        year = end.replace(year=end.year - 1)
    except ValueError:
        year = end.replace(year=end.year - 1, day=28)
    ref = [v for d, v in rows if year <= d < end - 60 * DAY]
    if len(recent) <= 30 or len(ref) <= 30:
        return None
    at = np.unique(recent + ref)
    a, b = (np.searchsorted(np.sort(x), at, side="right") / len(x) for x in (recent, ref))
    return np.abs(a - b).max(), len(recent), len(ref)


def test_ks_at_every_date_is_that_of_its_windows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        day = dt.date(2023, 2, 1) + DAY * i
        if rng.random() < 0.8 and not 300 < i < 380:
            for t in range(int(rng.integers(1, 3))):
                rows.append((day, f"T{t}", None if rng.random() < 0.1 else float(np.round(rng.normal(i / 300), 1)),
                             float("nan") if rng.random() < 0.1 else float(rng.integers(0, 4)), None))
    df = spark.createDataFrame(rows, "date date, ticker string, a double, b double, c double").repartition(5)
    ends = df.select("date").union(spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2030, 1, 1),)], "date date"))
    got = {(r.date, r.feature): (r.ks, r.n_recent, r.n_ref) for r in ST.ks_by_date(df, ["a", "b", "c"], ends, CFG).collect()}
    want = {}
    for col, name in ((2, "a"), (3, "b")):
        values = [(r[0], r[col]) for r in rows if r[col] is not None and not np.isnan(r[col])]
        for end in {r[0] for r in rows} | {dt.date(2024, 2, 29)}:
            ks = brute_ks(values, end)
            if ks:
                want[end, name] = ks
    assert set(got) == set(want) and len(want) > 300
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1:] == want[k][1:] for k in want)


def test_trailing_interval_is_the_bootstrap_of_its_window(spark):
    rng = np.random.default_rng(6)
    rows = [(dt.date(2024, 1, 1) + DAY * int(rng.integers(0, 90)), f"T{i}", str(rng.choice(["LONG", "SHORT"])), float(rng.random() < 0.4)) for i in range(160)]
    df = spark.createDataFrame(rows, "date date, ticker string, signal string, hit double").repartition(4)
    got = {(r.end, r.signal): (r.lo, r.hi) for r in ST.trailing_ci(df, "hit", ["date", "ticker"], "signal", n_boot=200).collect()}
    for end in (dt.date(2024, 1, 31), dt.date(2024, 2, 20), dt.date(2024, 3, 30)):
        window = df.where((F.col("date") <= F.lit(end)) & (F.col("date") >= F.date_sub(F.lit(end), 30)))
        for r in ST.bootstrap_ci(window, "hit", ["date", "ticker"], ["signal"], n_boot=200).collect():
            assert np.allclose(got[end, r.signal], (r.lo, r.hi))
    # Any other statistic goes the general way, from the same draws.
    a = ST.bootstrap_ci(df, "hit", ["date", "ticker"], ["signal"], n_boot=50).collect()
    b = ST.bootstrap_ci(df, "hit", ["date", "ticker"], ["signal"], stat=lambda c: F.sum(c) / F.count(c), n_boot=50).collect()
    assert {(r.signal, round(r.lo, 9), round(r.hi, 9), r.n) for r in a} == {(r.signal, round(r.lo, 9), round(r.hi, 9), r.n) for r in b}
    assert ST.bootstrap_ci(df, "hit", ["date", "ticker"], n_boot=20).first().n == 160


def test_one_rule_for_every_output(spark):
    """The warnings of a date are the same in the daily list and in the pause warnings as of it."""
    rng = np.random.default_rng(9)
    first = dt.date(2023, 1, 1)
    rows = [(first + DAY * i, f"T{t}", float(rng.random()), float(rng.random()), float(rng.random()), int(rng.random() < 0.5),
             None if rng.random() < 0.1 else int(rng.random() < 0.4)) for i in range(120) for t in range(4)]
    s = spark.createDataFrame(rows, "date date, ticker string, p_magnitude double, p_up double, iv_baseline_p double, y_magnitude int, y_direction int")
    feats = spark.createDataFrame([(first + DAY * i, f"T{t}", float(rng.normal(i / 100)), float(rng.normal())) for i in range(-300, 120) for t in range(3)],
                                  "date date, ticker string, a double, b double")
    scored = ST.scored(s)
    cfg = CFG.with_(marginal_auc_min=0.3, ks_drift_alert=0.15)
    some = [first + DAY * d for d in (45, 90, 119)]
    dates = spark.createDataFrame([(d,) for d in some], "date date")
    daily = MO.warnings_by_date(scored, s, feats, dates, cfg, ["a", "b"]).collect()
    for d in some:
        one = MO.pause_warnings(scored, s, feats, F.lit(d), cfg, ["a", "b"]).collect()
        assert sorted(tuple(r) for r in one) == sorted(tuple(r)[1:] for r in daily if r.date == d)
    assert {r.kind for r in daily} == {"hit_rate", "marginal_lift", "drift", "calibration"}
    # The interval counts: a hit rate below the minimum whose low end is not stays silent.
    window = scored.where(F.col("date").between(F.lit(some[0] - 30 * DAY), F.lit(some[0])))
    for r in ST.bootstrap_ci(MO.hits(window, s), "hit", ["date", "ticker"], ["signal"], seed=cfg.seed).collect():
        assert (r.point < 0.5 and r.lo < 0.5 and r.n >= 10) == any(x.kind == "hit_rate" and x.subject == r.signal and x.date == some[0] for x in daily)
    lists = {r.date: r.warnings for r in MO.warning_lists(MO.warnings_by_date(scored, s, feats, dates, cfg, ["a", "b"])).collect()}
    assert all(sorted(x.warning for x in daily if x.date == d) == lists[d] for d in some)
