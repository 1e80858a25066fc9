"""Stage B/C scoring of Stage A candidates (M10, J-KEY, F13, F15)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.config import DEFAULT, STAGE_B_FEATURES, Settings
from skewline.operators import walkforward as WF
from skewline.operators.stats import signal_cascade


def score_candidates(candidates: DataFrame, probs: DataFrame, bars_rv: DataFrame, k: DataFrame,
                     long_th, short_th, cfg: Settings = DEFAULT, top_features=None) -> DataFrame:
    """Signals for candidate (date, ticker) rows.

    ``probs`` holds p_magnitude, p_up, iv_baseline_p per (date, ticker) (model output or
    frozen); a candidate without probabilities is skipped.  threshold_pct =
    rv * sqrt(5/252) * 100 * k with rv from that day's bar (default 0.2) and k per ticker (and
    stamp, if ``k`` has one; default 1.5).  activity_score is the screen's relative score.  Columns rank and
    stamp of the candidates are kept; thresholds may be columns of theirs."""
    top = list(top_features or STAGE_B_FEATURES[:3])
    kept = [c for c in ("rank", "stamp") if c in candidates.columns]
    own = [c for c in ("long_threshold", "short_threshold") if c in candidates.columns]
    df = candidates.select("date", "ticker", F.col("score_rel").alias("activity_score"), *kept, *own).join(
        probs.select("date", "ticker", "p_magnitude", "p_up", "iv_baseline_p"), ["date", "ticker"], "inner")
    on = [c for c in ("stamp", "ticker") if c in k.columns]
    df = df.join(bars_rv.select("date", "ticker", "realized_vol_20d"), ["date", "ticker"], "left").join(
        k.select(*on, "k"), on, "left")
    rv = F.col("realized_vol_20d")
    rv_val = F.when(rv.isNotNull() & (rv != 0), rv).otherwise(F.lit(cfg.default_realized_vol))
    kk = F.coalesce(F.col("k"), F.lit(cfg.default_k_threshold))
    thr = rv_val * F.lit(math.sqrt(cfg.horizon_days / cfg.trading_days)) * F.lit(100.0) * kk
    lt = long_th if isinstance(long_th, Column) else F.lit(float(long_th))
    st = short_th if isinstance(short_th, Column) else F.lit(float(short_th))
    sig, conf = signal_cascade(F.col("p_magnitude"), F.col("p_up"), lt, st, cfg)
    ivp = F.coalesce(F.col("iv_baseline_p"), F.col("p_magnitude"))
    return df.select(
        "date", "ticker", *kept, "activity_score", "p_magnitude", "p_up", ivp.alias("iv_baseline_p"),
        (F.col("p_magnitude") - ivp).alias("marginal_lift"), lt.alias("long_threshold"), st.alias("short_threshold"),
        sig.alias("signal"), conf.alias("confidence"), thr.alias("threshold_pct"),
        F.array(*[F.lit(t) for t in top]).alias("top_features"),
        F.array().cast("array<string>").alias("leakage_caveats"))


def walk_forward(candidates: DataFrame, probs: DataFrame, bars_rv: DataFrame, stamps: DataFrame, k: DataFrame, thresholds: DataFrame,
                 cfg: Settings = DEFAULT, top_features=None) -> DataFrame:
    """M10 without look-ahead: every date is scored with k and the thresholds of the latest refit on or
    before it; dates before the first refit have no model and give no signals."""
    c = candidates.join(WF.model_at(candidates, stamps, cfg).select("date", "stamp"), "date").join(thresholds, "stamp", "left")
    c = c.withColumns({"long_threshold": F.coalesce("long_threshold", F.lit(0.55)), "short_threshold": F.coalesce("short_threshold", F.lit(0.45))})
    return score_candidates(c, probs, bars_rv, k, F.col("long_threshold"), F.col("short_threshold"), cfg, top_features)
