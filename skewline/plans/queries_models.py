"""Queries: model training and evaluation (rows-only checks: learners are not
bit-comparable across engines; acceptance is by metric bounds in the tests)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window
from pyspark.sql import functions as F

from skewline.config import STAGE_B_FEATURES, STAGE_C_FEATURES
from skewline.operators import screen as S
from skewline.operators import stats as ST
from skewline.operators import targets as TG
from skewline.operators import walkforward as WF
from skewline.operators.features import features_daily, stock_panel
from skewline.plans import models as MD
from skewline.plans import predict as PR
from skewline.plans.catalog import CFG, register
from skewline.session import materialize, shared_path


def _training(fx):
    stock = materialize(stock_panel(fx.v_bars, CFG), "stock")
    feats = features_daily(fx.v_options, fx.v_bars, fx.v_market, CFG, stock=stock)
    tf = materialize(TG.training_frame(feats, fx.v_bars, CFG, stock=stock), "training")
    return tf, materialize(MD.fold_roles(tf, CFG), "roles")


def _fold_table(a, name):
    return a.withColumn("model", F.lit(name)).withColumn("mean_auc", F.avg("auc").over(Window.partitionBy()))  # <= k rows


@register("iv_baseline")
def q_iv_baseline(fx):
    """M3: IV-only logistic baseline: purged-CV AUC per fold, mean, final coefficients."""
    tf, roles = _training(fx)
    a, final, _ = MD.iv_baseline(tf, roles, CFG)
    coef, icpt = float(final.coefficients[0]), float(final.intercept)
    return _fold_table(a, "iv_baseline").withColumn("coef", F.lit(coef)).withColumn("intercept", F.lit(icpt))


@register("stage_b_gbt")
def q_stage_b(fx):
    """M4 + M8: magnitude booster (100 trees, depth 4) purged-CV AUC per fold against the IV
    baseline, with the value-add gate (lift >= 0.03)."""
    tf, roles = _training(fx)
    _, _, _, a = MD.stage_cv(tf, roles, STAGE_B_FEATURES, "y_magnitude", CFG)
    ivb, _, _ = MD.iv_baseline(tf, roles, CFG)
    iv_mean = ivb.where(F.col("auc").isNotNull()).select(F.avg("auc")).scalar()
    out = _fold_table(a, "stage_b")
    lift = F.col("mean_auc") - F.coalesce(iv_mean, F.lit(0.5))
    return out.withColumn("iv_baseline_mean_auc", F.coalesce(iv_mean, F.lit(0.5))).withColumn(
        "auc_lift", lift).withColumn("adds_value", lift >= CFG.iv_baseline_min_auc_lift)


@register("platt_cv")
def q_platt_cv(fx):
    """M5: CV-ensemble of boosters with sigmoid (Platt) calibration: calibrated p per row."""
    tf, roles = _training(fx)
    return MD.platt_cv(tf, roles, STAGE_B_FEATURES, "y_magnitude", CFG)


def _final_b(fx):
    tf, roles = _training(fx)
    data = MD.packed(MD.design(tf, STAGE_B_FEATURES, "y_magnitude"), "design-b")
    return data, MD.fitted(MD.gbt(CFG), data)


@register("regime_pruning")
def q_regime_pruning(fx):
    """Per feature, mean |contribution| to the log-odds in calm and stressed VIX regimes."""
    data, model = _final_b(fx)
    return MD.regime_pruning(fx.spark, model, data, STAGE_B_FEATURES, CFG)


@register("top_features")
def q_top_features(fx):
    """The five most important Stage B features of the final booster."""
    _, model = _final_b(fx)
    rows = MD.top_features(model, list(STAGE_B_FEATURES), 5)
    return fx.spark.createDataFrame(rows, "rank int, feature string, importance double")


@register("stage_c_gbt")
def q_stage_c(fx):
    """M9 + A6: direction booster on all 15 features: purged-CV AUC per fold and the LONG/SHORT
    thresholds chosen on out-of-fold probabilities."""
    tf, roles = _training(fx)
    _, _, oof, a = MD.stage_cv(tf, roles, STAGE_C_FEATURES, "y_direction", CFG)
    th = ST.direction_thresholds(oof.select(F.col("p").alias("p_up"), F.col("label").alias("y_direction")), cfg=CFG)
    out = _fold_table(a, "stage_c")
    return out.withColumn("long_threshold", th.select("long_threshold").scalar()).withColumn(
        "short_threshold", th.select("short_threshold").scalar())


REFITS_STORED = 2
_MODELS: dict[tuple, tuple] = {}


def _stored_models(fx):
    """Train as of the last ``REFITS_STORED`` refits, each on the rows known before its stamp, and save
    them: (root, features, stock).  Kept for the application, as a store of models is."""
    key = (fx.spark.sparkContext.applicationId, fx.sf_dir)
    if key not in _MODELS:
        stock = materialize(stock_panel(fx.v_bars, CFG), "stock")
        feats = materialize(features_daily(fx.v_options, fx.v_bars, fx.v_market, CFG, stock=stock), "features")
        refits = WF.registry(WF.rows_by_stamp(TG.forward_returns(fx.v_bars, CFG, stock, known=True), CFG))
        root = shared_path(fx.spark, "artifacts")
        stamps = [r.stamp for r in refits.orderBy(F.col("stamp").desc()).limit(REFITS_STORED).collect()]
        bars = fx.v_bars

        def fitted(stamp):
            before = F.col("date") < F.lit(stamp)
            return PR.train(materialize(TG.training_frame(feats.where(before), bars.where(before), CFG), "training"), CFG)

        # Refits don't depend on each other; each is mostly a row of short jobs.
        with ThreadPoolExecutor(max_workers=REFITS_STORED) as pool:
            for stamp, model in zip(stamps, pool.map(fitted, stamps)):
                PR.save(model, fx.spark, root, stamp.strftime("%Y%m%d"))
        _MODELS[key] = root, feats, stock
    return _MODELS[key]


@register("model_artifacts")
def q_model_artifacts(fx):
    """The latest fitted model reloaded from its stamp: k per ticker with the thresholds, kept
    features and number of fold models."""
    root, _, _ = _stored_models(fx)
    m = PR.load(fx.spark, root)
    return m.k_by_ticker.select(F.lit(MD.latest_stamp(fx.spark, root)).alias("stamp"), "ticker", "k", "n_valid",
                                F.lit(len(m.magnitude.pairs)).alias("n_models"), F.lit(len(m.magnitude.features)).alias("n_features"),
                                F.lit(m.long_threshold).alias("long_threshold"), F.lit(m.short_threshold).alias("short_threshold"))


@register("predict_signals")
def q_predict_signals(fx):
    """M10 end to end: stored models score the Stage A candidates of their dates."""
    root, feats, stock = _stored_models(fx)
    stage = S.stage_a(S.screening_panel(fx.v_bars, CFG), fx.v_bars, fx.v_options, feats, fx.v_market, CFG, events=fx.v_event_calendar)
    rv = stock.select("date", "ticker", "realized_vol_20d")
    return PR.walk_forward(fx.spark, root, materialize(stage.where("candidate"), "candidates"), feats, rv, CFG)


@register("signal_drivers")
def q_signal_drivers(fx):
    """A19 for single rows: the three features that add most to each row's log-odds of a large move, by the
    latest stored model, for the dates it may score."""
    root, feats, _ = _stored_models(fx)
    stamp = MD.latest_stamp(fx.spark, root)
    return PR.load(fx.spark, root).drivers(feats.where(F.col("date") >= F.to_date(F.lit(stamp), "yyyyMMdd")))
