"""Queries: forward targets, k calibration, purged folds and the training frame."""

from __future__ import annotations

from skewline import sqlcheck as Q
from skewline.config import FEATURE_NAMES
from skewline.operators import cv
from skewline.operators import targets as TG
from skewline.operators.features import features_daily, stock_panel
from skewline.session import materialize
from skewline.plans.catalog import CFG, register, select_sql

VIEWS = ["v_options", "v_bars", "v_market"]
FT_CTES = Q.stock_ctes(CFG) + Q.target_ctes(CFG)
TARGET_OUT = ["~date", "~ticker", "fwd_ret", "sigma", "k", "threshold", "~y_magnitude", "~y_direction"]


def _targets(fx):
    fr = TG.forward_returns(fx.v_bars, CFG)
    return TG.label_targets(fr, TG.calibrate_k(fr, CFG), CFG)


@register("forward_targets", Q.build(FT_CTES + Q.kcal_ctes(CFG, "ft") + [Q.label_cte("lab", "ft", "kcal", CFG)],
                                     select_sql(TARGET_OUT, "lab"), views=["v_bars"]))
def q_forward_targets(fx):
    """5-session forward log return (entry next open), horizon sigma, k, labels."""
    return _targets(fx).select("date", "ticker", "fwd_ret", "sigma", "k", "threshold", "y_magnitude", "y_direction")


@register("calibrate_k", Q.build(FT_CTES + Q.kcal_ctes(CFG, "ft"), select_sql(["~ticker", "k", "~n_valid"], "kcal"),
                                 views=["v_bars"]))
def q_calibrate_k(fx):
    """A5: per-ticker k giving a ~30 % magnitude base rate (grid 0.5..3.0, 50 points)."""
    return TG.calibrate_k(TG.forward_returns(fx.v_bars, CFG), CFG)


@register("fold_ids", Q.build(FT_CTES + Q.fold_ctes("ft", CFG.cv_n_folds), "SELECT date, fold FROM fo",
                              views=["v_bars"]))
def q_fold_ids(fx):
    """Contiguous date blocks for 5-fold CV over the target dates."""
    return cv.fold_ids(TG.forward_returns(fx.v_bars, CFG), CFG.cv_n_folds)


@register("purged_folds", Q.build(FT_CTES + Q.fold_ctes("ft", CFG.cv_n_folds) + [Q.roles_cte(CFG)],
                                  "SELECT fold, date, role FROM roles", views=["v_bars"]))
def q_purged_folds(fx):
    """J-RANGE/M2: test / purged / train role of each date in each fold (horizon 5, embargo 5)."""
    return cv.purged_folds(cv.fold_ids(TG.forward_returns(fx.v_bars, CFG), CFG.cv_n_folds), CFG)


TRAIN_OUT = (["~date", "~ticker"] + list(FEATURE_NAMES)
             + ["stock_close", "realized_vol_20d", "fwd_ret", "sigma", "k", "~y_magnitude", "~y_direction"])


@register("training_frame", Q.build(Q.training_ctes(CFG), select_sql(TRAIN_OUT, "tframe"), views=VIEWS,
                                    recursive=True))
def q_training_frame(fx):
    """M1: features + stock + targets over the trailing 2 years + 30 days, k from the frame."""
    stock = materialize(stock_panel(fx.v_bars, CFG), "stock")
    feats = features_daily(fx.v_options, fx.v_bars, fx.v_market, CFG, stock=stock)
    tf = TG.training_frame(feats, fx.v_bars, CFG, stock=stock)
    return tf.select(*[c.lstrip("~") for c in TRAIN_OUT])
