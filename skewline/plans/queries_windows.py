"""Queries: contract pricing, chain look-ups, time-series windows and features_daily."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from skewline import sqlcheck as Q
from skewline.operators import chain as C
from skewline.operators.features import features_daily, features_range, stock_panel
from skewline.operators.market import market_features
from skewline.operators.nightly import empty_state, night
from skewline.operators.rolling import ewm_var, log_returns, realized_vol, rolling_pct_rank, wspec
from skewline.plans.catalog import CFG, register, select_sql
from skewline.session import materialize, shared_path
from skewline.sources.tables import read_table, upsert_partitions

W = f"PARTITION BY ticker ORDER BY date"


# --------------------------------------------------------------------------- windows

@register("log_returns", Q.build([], f"""
SELECT date, ticker, {Q.r6(f"ln(close / lag(close, 1) OVER ({W}))")} AS ret_1d,
  {Q.r6(f"ln(close / lag(close, 5) OVER ({W}))")} AS ret_5d FROM v_bars""", views=["v_bars"]))
def q_log_returns(fx):
    """1- and 5-row log returns per ticker."""
    return log_returns(fx.v_bars.select("date", "ticker", "close")).drop("close")


@register("realized_vol_20d", Q.build(Q.stock_ctes(CFG)[:2], select_sql(["~date", "~ticker", "realized_vol_20d"], "sp1"),
                                      views=["v_bars"]))
def q_realized_vol(fx):
    """20-row sample std of log returns x sqrt(252); NULL until 20 returns exist."""
    df = log_returns(fx.v_bars.select("date", "ticker", "close"), lags=(1,))
    return df.select("date", "ticker", realized_vol(F.col("ret_1d"), wspec(), 20, 252).alias("realized_vol_20d"))


@register("ewma_var", Q.build(Q.stock_ctes(CFG), select_sql(
    ["~date", "~ticker", "ewma_var", "sqrt(ewma_var * 252e0) AS ewma_vol"], "sp"), views=["v_bars"]))
def q_ewma_var(fx):
    """Bias-corrected EWMA variance of daily log returns (lambda 0.94) and its annualised vol."""
    df = log_returns(fx.v_bars.select("date", "ticker", "close"), lags=(1,))
    df = ewm_var(df, "ret_1d", "ewma_var", CFG.ewma_lambda)
    return df.select("date", "ticker", "ewma_var", F.sqrt(F.col("ewma_var") * F.lit(252.0)).alias("ewma_vol"))


@register("rolling_z", Q.build(Q.stock_ctes(CFG), select_sql(
    ["~date", "~ticker", "z_5d_return", "z_realized_vol_20d"], "sp"), views=["v_bars"]))
def q_rolling_z(fx):
    """252-row z of the 5-day return and of 20-day realized vol (>= 60 values)."""
    return stock_panel(fx.v_bars, CFG).select("date", "ticker", "z_5d_return", "z_realized_vol_20d")


def _prank_sql(col):
    return (f"CASE WHEN a.{col} IS NOT NULL AND count(b.{col}) >= 60 THEN " + Q.r6(
        f"(count(CASE WHEN b.{col} < a.{col} THEN 1 END) + (count(CASE WHEN b.{col} = a.{col} THEN 1 END) + 1e0) / 2e0)"
        f" / count(b.{col})") + " END")


@register("pct_rank", Q.build(
    [("b0", f"SELECT date, ticker, close, volume, row_number() OVER ({W}) AS rn FROM v_bars")],
    f"""SELECT a.date, a.ticker, {_prank_sql('close')} AS close_pct_rank_252d,
  {_prank_sql('volume')} AS volume_pct_rank_252d
FROM b0 a JOIN b0 b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 251 AND a.rn
GROUP BY a.date, a.ticker, a.close, a.volume""", views=["v_bars"]))
def q_pct_rank(fx):
    """252-row average-rank percentile of close and of volume (volume has ties)."""
    w = wspec()
    return fx.v_bars.select(
        "date", "ticker",
        rolling_pct_rank(F.col("close"), w, 252, 60).alias("close_pct_rank_252d"),
        rolling_pct_rank(F.col("volume"), w, 252, 60).alias("volume_pct_rank_252d"),
    )


@register("vix_3obs_z", Q.build(Q.market_ctes(CFG), select_sql(["~date", "z_vix_3d_change"], "mf"),
                                views=["v_market"]))
def q_vix_z(fx):
    """Z of the 3-observation VIX change on non-null rows; needs that day's VIX."""
    return market_features(fx.v_market, CFG).select("date", "z_vix_3d_change")


@register("oas_5obs_z_carry", Q.build(Q.market_ctes(CFG), select_sql(["~date", "z_hy_oas_5d_change"], "mf"),
                                      views=["v_market"]))
def q_oas_z(fx):
    """W8 + J-CARRY: z of the 5-observation HY OAS change, carried from the latest observation."""
    return market_features(fx.v_market, CFG).select("date", "z_hy_oas_5d_change")


# --------------------------------------------------------------------------- chains

PRICE_COLS = ["~date", "~ticker", "~underlying", "spot", "r", "mid_price", "t_years", "iv_computed"]


@register("contract_iv", Q.build(Q.pricing_ctes(CFG, "INNER"), select_sql(PRICE_COLS, "priced"),
                                 views=["v_options", "v_bars", "v_market"], recursive=True))
def q_contract_iv(fx):
    """F3/F5/F6/P9/P10/J-MAP/J-SCALAR: mid price and implied vol of every contract with a spot."""
    p = C.price_contracts(fx.v_options, fx.v_bars, fx.v_market, CFG, how="inner")
    return p.select("date", "ticker", "underlying", "spot", "r", "mid_price", "t_years", "iv_computed")


@register("contract_greeks", Q.build(Q.pricing_ctes(CFG, "INNER"), select_sql(
    ["~date", "~ticker", "iv_computed", "delta", "gamma"], "priced"),
    views=["v_options", "v_bars", "v_market"], recursive=True))
def q_contract_greeks(fx):
    """BSM delta and gamma at the implied vol."""
    p = C.price_contracts(fx.v_options, fx.v_bars, fx.v_market, CFG, how="inner")
    return p.select("date", "ticker", "iv_computed", "delta", "gamma")


CHAIN_VIEWS = ["v_options", "v_bars", "v_market"]


def _chain_sql(cols):
    return Q.build(Q.pricing_ctes(CFG) + Q.chain_ctes(), select_sql(cols, "chainsum"), views=CHAIN_VIEWS,
                   recursive=True)


def _summary(fx):
    return C.price_chains(fx.v_options, fx.v_bars, fx.v_market, CFG)


@register("iv_by_delta", _chain_sql(["~date", "~underlying", "iv_call_50", "iv_put_50", "iv_call_25", "iv_put_25"]))
def q_iv_by_delta(fx):
    """J-NEAR-delta: IV of the contract nearest to delta 0.5C, -0.5P, 0.25C, -0.25P per chain."""
    return _summary(fx).select("date", "underlying", "iv_call_50", "iv_put_50", "iv_call_25", "iv_put_25")


@register("iv_by_dte", _chain_sql(["~date", "~underlying", "iv_30", "iv_60"]))
def q_iv_by_dte(fx):
    """J-NEAR-DTE: IV of the contract nearest to 30 and 60 days to expiry per chain."""
    return _summary(fx).select("date", "underlying", "iv_30", "iv_60")


@register("skew_term_cw", Q.build(Q.pricing_ctes(CFG) + Q.chain_ctes(), select_sql(
    ["~date", "~underlying", "iv_atm_30dte", "skew_25d", "term_structure_60_30", "cw_iv_spread"], "chainf"),
    views=CHAIN_VIEWS, recursive=True))
def q_skew_term_cw(fx):
    """ATM IV, 25-delta skew, 60/30 term structure, call-put IV spread."""
    return C.chain_features(_summary(fx)).select("date", "underlying", "iv_atm_30dte", "skew_25d",
                                                 "term_structure_60_30", "cw_iv_spread")


@register("call_put_ratio", Q.build(Q.chain_ctes()[6:7] + [("x", """
SELECT *, CASE WHEN put_volume > 0 THEN call_volume / put_volume END AS call_put_volume_ratio FROM cvol""")],
    select_sql(["~date", "~underlying", "call_volume", "put_volume", "call_put_volume_ratio"], "x"),
    views=["v_options"]))
def q_call_put_ratio(fx):
    """A4: call volume / put volume per chain; NULL when put volume is not positive."""
    o = fx.v_options
    typ = F.col("contract_type")
    s = o.groupBy("date", "underlying").agg(
        F.coalesce(F.sum(F.when(typ == "call", F.col("volume"))), F.lit(0.0)).alias("call_volume"),
        F.coalesce(F.sum(F.when(typ == "put", F.col("volume"))), F.lit(0.0)).alias("put_volume"),
    )
    return s.withColumn("call_put_volume_ratio",
                        F.when(F.col("put_volume") > 0, F.col("call_volume") / F.col("put_volume")))


FEATURE_OUT = ["~date", "~ticker", "iv_atm_30dte", "iv_pct_rank_252d", "iv_minus_ewma_rv", "z_iv_minus_ewma_rv",
               "skew_pct_rank_252d", "term_structure_60_30", "z_call_put_volume_ratio", "z_5d_return", "vix_level",
               "z_vix_3d_change", "vix3m_level", "z_hy_oas_5d_change", "dspx_level", "cor1m_level",
               "z_realized_vol_20d", "cw_iv_spread", "call_put_volume_ratio", "skew_25d"]
FEATURES_SQL = Q.build(Q.feature_ctes(CFG), select_sql(FEATURE_OUT, "feat"), views=CHAIN_VIEWS, recursive=True)


@register("features_daily", FEATURES_SQL)
def q_features_daily(fx):
    """The fifteen model features (+ iv_minus_ewma_rv, call_put_volume_ratio, skew_25d) per (date, ticker)."""
    return features_daily(fx.v_options, fx.v_bars, fx.v_market, CFG)


RANGE_DAYS = 90
NIGHTLY_STEPS = 3


@register("nightly_features", Q.build(Q.feature_ctes(CFG), select_sql(
    FEATURE_OUT, "feat", f"WHERE date >= (SELECT max(date) FROM v_options) - {RANGE_DAYS}"), views=CHAIN_VIEWS, recursive=True))
def q_nightly_features(fx):
    """W2-W5/U1/P3 from stored window state: the state of the days before the last 90 days is stored, then three
    runs of 30 days each read only their own bars and contracts and the state before them."""
    start, end = fx.v_options.select(F.date_sub(F.max("date"), RANGE_DAYS), F.max("date")).first()
    step = datetime.timedelta(-(-(RANGE_DAYS + 1) // NIGHTLY_STEPS))
    days = lambda df, lo, hi: df.where((F.col("date") >= F.lit(lo)) & (F.col("date") < F.lit(hi)))
    history = datetime.date(1900, 1, 1)
    _, state = night(days(fx.v_options, history, start), days(fx.v_bars, history, start), fx.v_market, empty_state(fx.spark), CFG)
    out, lo = None, start
    while lo <= end:
        hi = min(lo + step, end + datetime.timedelta(1))
        state = materialize(state, "window-state")
        new, state = night(days(fx.v_options, lo, hi), days(fx.v_bars, lo, hi), days(fx.v_market, history, hi), state, CFG)
        out, lo = (new if out is None else out.unionByName(new)), hi
    return out


@register("features_range", Q.build(Q.feature_ctes(CFG), select_sql(
    FEATURE_OUT, "feat", f"WHERE date >= (SELECT max(date) FROM v_options) - {RANGE_DAYS}"), views=CHAIN_VIEWS, recursive=True))
def q_features_range(fx):
    """The last 90 days as a nightly run makes them: earlier feature rows come from the
    stored table, only contracts of the range are priced."""
    start, end = fx.v_options.select(F.date_sub(F.max("date"), RANGE_DAYS), F.max("date")).first()
    root = shared_path(fx.spark, "nightly")
    before = features_daily(fx.v_options.where(F.col("date") < F.lit(start)), fx.v_bars, fx.v_market, CFG)
    upsert_partitions(fx.spark, root, "features_daily", before)
    return features_range(fx.v_options, fx.v_bars, fx.v_market, read_table(fx.spark, root, "features_daily"), start, end, CFG)
