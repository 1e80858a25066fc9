"""Model training, storing and scoring: metric bounds, reload equality, gates."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewline.config import FEATURE_NAMES, DEFAULT
from skewline.plans import models as MD
from skewline.plans import predict as PR

CFG = DEFAULT.with_(gbt_max_iter=5, gbt_max_depth=3, cv_n_folds=3)


def _rows(days=240, tickers=6):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(days):
        for t in range(tickers):
            x = rng.normal(size=len(FEATURE_NAMES))
            x[7] = 10 + 5 * abs(x[7])
            p = 1 / (1 + np.exp(-1.5 * x[2] - 1.0 * x[5]))
            up = 1 / (1 + np.exp(-2 * x[6]))
            row = [None if rng.random() < 0.02 else float(v) for v in x]
            rows.append((dt.date(2023, 1, 1) + dt.timedelta(d), f"T{t}", *row, int(rng.random() < p), int(rng.random() < up), float(rng.normal(0, 0.02)), 0.02))
    return rows


SCHEMA = "date date, ticker string, " + ", ".join(f"{f} double" for f in FEATURE_NAMES) + ", y_magnitude int, y_direction int, fwd_ret double, sigma double"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows(), SCHEMA).withColumn("ratio", F.abs(F.col("fwd_ret")) / F.col("sigma"))


@pytest.fixture(scope="module")
def model(frame):
    return PR.train(frame, CFG)


def test_out_of_fold_auc_and_kept_features(model):
    auc = {}
    for r in model.metrics.collect():
        auc.setdefault(r.model, []).append(r.auc)
    assert np.mean(auc["stage_b"]) > 0.7 and np.mean(auc["stage_c"]) > 0.7
    assert {"z_iv_minus_ewma_rv", "z_call_put_volume_ratio"} <= set(model.magnitude.features) and len(model.magnitude.features) < 14
    assert set(model.top_features[:2]) == {"z_iv_minus_ewma_rv", "z_call_put_volume_ratio"}
    assert all(0.35 <= t <= 0.65 for t in (model.short_threshold, model.long_threshold))


def test_probabilities_are_calibrated(model, frame):
    rows = model.predict(frame).join(frame.select("date", "ticker", "y_magnitude"), ["date", "ticker"]).collect()
    p, y = np.array([r.p_magnitude for r in rows]), np.array([r.y_magnitude for r in rows])
    assert ((p >= 0) & (p <= 1)).all() and len(rows) == frame.count()
    for lo in (0.2, 0.4, 0.6):
        own = (p >= lo) & (p < lo + 0.2)
        if own.sum() > 60:
            assert abs(p[own].mean() - y[own].mean()) < 0.12


def test_saved_model_scores_the_same(spark, model, frame):
    root = tempfile.mkdtemp(prefix="skewline-model-")
    PR.save(model, spark, root, "20230801")
    PR.save(model, spark, root, "20230901")
    assert MD.latest_stamp(spark, root) == "20230901" and MD.latest_stamp(spark, root + "/none") is None
    again = PR.load(spark, root)
    key = lambda r: (r.date, r.ticker)
    a, b = (sorted(m.predict(frame).collect(), key=key) for m in (model, again))
    assert a == b and again.top_features == model.top_features and again.long_threshold == model.long_threshold
    candidates = frame.select("date", "ticker", F.lit(1.0).alias("score_rel")).limit(50)
    rv = frame.select("date", "ticker", F.lit(0.3).alias("realized_vol_20d"))
    out = again.signals(candidates, frame, rv, CFG).collect()
    assert len(out) == 50 and {r.signal for r in out} <= {"LONG", "SHORT", "WATCH", "NO_DIRECTION"}
    assert all(r.top_features == model.top_features for r in out)


def test_each_date_is_scored_by_its_refit(spark, model, frame):
    """Two stored models: later dates by the second, earlier ones by the first, dates before both by none."""
    import copy

    other = copy.copy(model)
    other.long_threshold, other.short_threshold, other.top_features = 0.99, 0.01, model.top_features[::-1]
    root = tempfile.mkdtemp(prefix="skewline-registry-")
    PR.save(model, spark, root, "20230301")
    PR.save(other, spark, root, "20230601")
    assert sorted(r.stamp for r in PR.registry(spark, root).collect()) == [dt.date(2023, 3, 1), dt.date(2023, 6, 1)]
    candidates = frame.select("date", "ticker", F.lit(1.0).alias("score_rel"))
    rv = frame.select("date", "ticker", F.lit(0.3).alias("realized_vol_20d"))
    got = {(r.date, r.ticker): r for r in PR.walk_forward(spark, root, candidates, frame, rv, CFG).collect()}
    assert {d for d, _ in got} == {r.date for r in frame.collect() if r.date >= dt.date(2023, 3, 1)}
    for (d, _), r in got.items():
        want = (dt.date(2023, 3, 1), model) if d < dt.date(2023, 6, 1) else (dt.date(2023, 6, 1), other)
        assert r.stamp == want[0] and r.long_threshold == want[1].long_threshold and r.top_features == want[1].top_features
    early = candidates.where(F.col("date") < F.lit(dt.date(2023, 6, 1)))
    again = {(r.date, r.ticker): r for r in PR.walk_forward(spark, root, early, frame, rv, CFG).collect()}
    assert again == {k: r for k, r in got.items() if k[0] < dt.date(2023, 6, 1)}


def test_drivers_are_the_largest_contributions(model, frame):
    out = model.drivers(frame, 2).collect()
    assert len(out) == 2 * frame.count() and {r.rank for r in out} == {1, 2}
    first = {(r.date, r.ticker): abs(r.contribution) for r in out if r.rank == 1}
    assert all(abs(r.contribution) <= first[r.date, r.ticker] for r in out)
    names = [r.feature for r in out if r.rank == 1]
    assert sum(n in ("z_iv_minus_ewma_rv", "z_call_put_volume_ratio") for n in names) / len(names) > 0.8


def test_too_few_rows_are_refused(frame):
    with pytest.raises(ValueError, match="200"):
        PR.train(frame.limit(150), CFG)


def test_small_regimes_have_no_say(spark, frame):
    few = frame.orderBy("date", "ticker").limit(24)
    data = MD.design(few, FEATURE_NAMES, "y_magnitude")
    out = MD.regime_pruning(spark, MD.gbt(CFG).fit(data), data, FEATURE_NAMES, CFG).collect()
    assert len(out) == len(FEATURE_NAMES) and all(r.kept for r in out) and all(r.calm_effect is None for r in out)


def test_ridge_of_the_baseline_uses_the_rows_fitted(frame):
    from skewline.plans.models import fold_roles, iv_baseline

    auc, final, oof = iv_baseline(frame, fold_roles(frame, CFG), CFG)
    assert auc.count() == 3 and oof.count() <= frame.count() and np.isfinite(float(final.coefficients[0]))
