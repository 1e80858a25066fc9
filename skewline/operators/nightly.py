"""Nightly features from stored window state (W2-W5, U1, P3): a night reads no old bars.

The state has one row a ticker: the bars' count, the EWMA sums after the last bar, the last closes
(as many as the longest window of the stock panel looks back) and the last values that the
feature windows look back on.  Its size follows from the windows, not from the history.  A night
(or any range of dates after the state) unrolls these tails, puts its own rows behind them,
runs the windows of the full history over both, and folds the result into the next state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings
from skewline.operators.features import daily_values, with_history
from skewline.operators.rolling import EWM_MOMENTS, ewm_var, realized_vol, with_rolling_z, wspec

FEATURE_TAIL = ("iv_atm_30dte", "skew_25d", "call_put_volume_ratio", "iv_minus_ewma_rv")
STATE = ("ticker string, depth long, bars array<struct<date: date, close: double>>, "
         "ewma struct<s0: double, s1: double, s2: double, s3: double, nobs: long>, "
         f"features array<struct<date: date, {', '.join(f'{c}: double' for c in FEATURE_TAIL)}>>")


def bars_kept(cfg: Settings = DEFAULT) -> int:
    """Closes behind the oldest return of the oldest volatility in a full window, and that window."""
    return cfg.rolling_window + cfg.rv_window + 1


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _tail(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), F.lit(n))


def stock_from_state(bars: DataFrame, state: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The stock panel (see ``features.stock_panel``) of the new bars and of each ticker's last stored
    one, with ``ewma``, the sums after each row, and ``new``."""
    old = state.select("ticker", F.inline("bars")).withColumn("new", F.lit(False))
    rows = bars.select("date", "ticker", "close").withColumn("new", F.lit(True)).unionByName(old)
    w = wspec()
    s = rows.withColumns({"ret_1d": F.log(F.try_divide(F.col("close"), F.lag("close", 1).over(w))),
                          "ret_5d": F.log(F.try_divide(F.col("close"), F.lag("close", 5).over(w))),
                          "last_stored": ~F.col("new") & F.lead("new", 1, True).over(w)})
    s = s.withColumn("realized_vol_20d", realized_vol(F.col("ret_1d"), w, cfg.rv_window, cfg.trading_days))
    for x, out in (("ret_5d", "z_5d_return"), ("realized_vol_20d", "z_realized_vol_20d")):
        s = with_rolling_z(s, x, out, window=cfg.rolling_window, min_periods=cfg.rolling_min_periods)
    s = s.where("new or last_stored").join(state.select("ticker", F.col("depth").alias("_depth"), F.col("ewma").alias("_seed")), "ticker", "left")
    fresh = ewm_var(s.where("new"), "ret_1d", "ewma_var", cfg.ewma_lambda, seed="_seed", moments="ewma")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    fresh = fresh.withColumn("history_depth", F.coalesce("_depth", F.lit(0)) + F.count(F.lit(1)).over(up_to))
    e = F.col("_seed")
    mean, denom = e["s1"] / e["s0"], e["s0"] * e["s0"] - e["s3"]
    var = F.when((e["nobs"] >= 2) & (denom > 0), (e["s2"] / e["s0"] - mean * mean) * (e["s0"] * e["s0"]) / denom)
    kept = s.where("last_stored").select("*", var.alias("ewma_var"), e.alias("ewma"), F.col("_depth").alias("history_depth"))
    columns = ["date", "ticker", "close", "new", "ret_1d", "ret_5d", "realized_vol_20d", "ewma_var", "z_5d_return", "z_realized_vol_20d",
               "history_depth", "ewma"]
    return fresh.select(*columns).unionByName(kept.select(*columns))


def night(options: DataFrame, bars: DataFrame, market: DataFrame, state: DataFrame, cfg: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(features_daily, next state) of the dates of ``options`` and ``bars``, all of which come after the
    state's.  ``market`` is the calendar-sized table up to these dates."""
    stock = stock_from_state(bars, state, cfg)
    new = daily_values(options, bars, market, cfg, stock)
    stored = state.select("ticker", F.inline("features"))
    values = new.withColumn("_new", F.lit(True)).unionByName(stored.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    first = F.least(*[t.select(F.min("date")).scalar() for t in (options, bars)])
    features = with_history(values.drop("_new"), market, cfg).where(F.col("date") >= first)
    # The next state: tails of the old rows and the new ones.
    closes = (state.select("ticker", F.inline("bars")).unionByName(bars.select("ticker", "date", "close"))
              .groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("_b")))
    ended = stock.where("new").groupBy("ticker").agg(F.max_by(F.struct("history_depth", "ewma"), "date").alias("_e"))
    tails = (values.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", *FEATURE_TAIL))).alias("_f")))
    after = state.join(closes, "ticker", "full").join(ended, "ticker", "full").join(tails, "ticker", "full")
    sums = F.when(F.col("_e").isNotNull(), F.col("_e.ewma")).otherwise(F.col("ewma"))
    after = after.select(
        "ticker", F.coalesce(F.col("_e.history_depth"), F.col("depth")).alias("depth"),
        _tail(F.coalesce("_b", F.array().cast("array<struct<date: date, close: double>>")), bars_kept(cfg)).alias("bars"),
        F.struct(*[sums[n].alias(n) for n in EWM_MOMENTS]).alias("ewma"),
        _tail(F.coalesce("_f", state_array(state)), cfg.rolling_window - 1).alias("features"))
    return features, after


def state_array(state: DataFrame) -> Column:
    return F.array().cast(state.schema["features"].dataType)
