"""The fifteen point-in-time features (features_daily) for all dates and tickers at once.

Plan shape:
  contracts --(date, underlying) shuffle--> chain summary   (one row per chain)
  bars      --ticker window-->              stock panel      (returns, vols, z)
  chain rows + stock rows --ticker window--> as-of stock values, feature windows
  market    --single small window-->        market features  --date join-->
Every value for date d is computed from rows dated <= d only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings
from skewline.operators.chain import chain_features, price_chains, truthy
from skewline.operators.market import market_features
from skewline.operators.rolling import ewm_var, realized_vol, rolling_pct_rank, wspec, with_rolling_z

FEATURE_COLUMNS = (
    "iv_atm_30dte",
    "iv_pct_rank_252d",
    "iv_minus_ewma_rv",
    "z_iv_minus_ewma_rv",
    "skew_pct_rank_252d",
    "term_structure_60_30",
    "z_call_put_volume_ratio",
    "z_5d_return",
    "vix_level",
    "z_vix_3d_change",
    "vix3m_level",
    "z_hy_oas_5d_change",
    "dspx_level",
    "cor1m_level",
    "z_realized_vol_20d",
    "cw_iv_spread",
    "call_put_volume_ratio",
    "skew_25d",
)


def stock_panel(bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """W1-W5 on stock bars: ret_1d, ret_5d, realized_vol_20d, ewma_var, their z-scores and
    the running bar count (A2)."""
    w = wspec()
    s = bars.select("date", "ticker", "open", "close")
    s = s.withColumns({"ret_1d": F.log(F.try_divide(F.col("close"), F.lag("close", 1).over(w))),
                       # Fixed value: the feature is a five-session return, whatever the horizon.
                       "ret_5d": F.log(F.try_divide(F.col("close"), F.lag("close", 5).over(w))),
                       "history_depth": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    s = s.withColumn("realized_vol_20d", realized_vol(F.col("ret_1d"), w, cfg.rv_window, cfg.trading_days))
    s = ewm_var(s, "ret_1d", "ewma_var", cfg.ewma_lambda)
    s = with_rolling_z(s, "ret_5d", "z_5d_return", window=cfg.rolling_window,
                       min_periods=cfg.rolling_min_periods)
    return with_rolling_z(s, "realized_vol_20d", "z_realized_vol_20d", window=cfg.rolling_window,
                          min_periods=cfg.rolling_min_periods)


def chain_rows(options: DataFrame, bars: DataFrame, market: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return chain_features(price_chains(options, bars, market, cfg))


def features_daily(options: DataFrame, bars: DataFrame, market: DataFrame, cfg: Settings = DEFAULT,
                   stock: DataFrame | None = None) -> DataFrame:
    """All dates.  ``stock`` may pass a stock panel already computed (see ``stock_panel``)."""
    return with_history(daily_values(options, bars, market, cfg, stock), market, cfg)


def features_range(options: DataFrame, bars: DataFrame, market: DataFrame, history: DataFrame, start, end,
                   cfg: Settings = DEFAULT) -> DataFrame:
    """The features of start <= date <= end, as a nightly run or a backfill makes them.

    Only contracts of those dates are read and priced; the feature windows take the rows
    before from ``history`` (stored features_daily).  Bars, one row a ticker and date, are
    read up to ``end``, since depth and EWMA reach back to the first.  Equal to the same
    dates of ``features_daily`` when ``history`` holds all earlier dates."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    new = daily_values(options.where(F.col("date").between(lo, hi)), bars.where(F.col("date") <= hi), market, cfg)
    back = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    old = (history.where(F.col("date") < lo).select(*new.columns)
           .withColumn("_back", F.row_number().over(back)).where(F.col("_back") < cfg.rolling_window).drop("_back"))
    return with_history(new.unionByName(old), market.where(F.col("date") <= hi), cfg).where(F.col("date") >= lo)


def daily_values(options: DataFrame, bars: DataFrame, market: DataFrame, cfg: Settings = DEFAULT,
                 stock: DataFrame | None = None) -> DataFrame:
    """Values of each (date, ticker) chain that need no earlier feature rows."""
    chains = chain_rows(options, bars, market, cfg).withColumnRenamed("underlying", "ticker")
    stock = stock_panel(bars, cfg) if stock is None else stock

    # As-of join of stock values onto chain rows: one timeline per ticker where a bar
    # sorts before a chain row of the same date; carry the latest bar's values.
    bar_vals = stock.select(
        "date", "ticker", F.lit(0).alias("_kind"),
        F.struct(
            F.col("date").alias("bar_date"), "history_depth", "z_5d_return", "z_realized_vol_20d", "ewma_var"
        ).alias("_bar"),
    )
    timeline = chains.withColumn("_kind", F.lit(1)).unionByName(bar_vals, allowMissingColumns=True)
    w_t = Window.partitionBy("ticker").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    f = timeline.withColumn("_bar", F.last("_bar", ignorenulls=True).over(w_t)).where(
        (F.col("_kind") == 1) & F.col("_bar").isNotNull()
    )
    bar = F.col("_bar")
    depth = bar.getField("history_depth")
    ewma_today = F.when(bar.getField("bar_date") == F.col("date"), bar.getField("ewma_var"))
    ewma_rv = F.sqrt(ewma_today * F.lit(float(cfg.trading_days)))
    iv_atm = F.col("iv_atm_30dte")
    f = f.select(
        "date", "ticker", "iv_atm_30dte", "skew_25d", "term_structure_60_30", "cw_iv_spread",
        "call_put_volume_ratio",
        F.when(depth > 5, bar.getField("z_5d_return")).alias("z_5d_return"),
        F.when(depth > cfg.rolling_min_periods, bar.getField("z_realized_vol_20d")).alias("z_realized_vol_20d"),
        F.when(truthy(iv_atm) & truthy(ewma_rv), iv_atm - ewma_rv).alias("iv_minus_ewma_rv"),
    )
    return f


def with_history(f: DataFrame, market: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Feature-history windows over each ticker's own feature rows (W5, W6) and the market row."""
    w, iv_atm = wspec(), F.col("iv_atm_30dte")
    win, minp = cfg.rolling_window, cfg.rolling_min_periods
    f = f.select(
        "*",
        F.when(truthy(iv_atm), rolling_pct_rank(iv_atm, w, win, minp)).alias("iv_pct_rank_252d"),
        F.when(F.col("skew_25d").isNotNull(), rolling_pct_rank(F.col("skew_25d"), w, win, minp)).alias(
            "skew_pct_rank_252d"),
    )
    f = with_rolling_z(f, "call_put_volume_ratio", "z_call_put_volume_ratio", window=win, min_periods=minp,
                       when=truthy(F.col("call_put_volume_ratio")))
    f = with_rolling_z(f, "iv_minus_ewma_rv", "z_iv_minus_ewma_rv", window=win, min_periods=minp)
    mkt = market_features(market, cfg)
    return f.join(mkt, "date", "left").select("date", "ticker", *FEATURE_COLUMNS)
