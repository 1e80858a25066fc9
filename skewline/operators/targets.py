"""Targets (W11, F13, F14), k calibration (A5) and the training frame (M1).

Forward returns lead over the ticker's own stock sessions, so the horizon counts
trading days.  k is calibrated per ticker without a grid cross join: each row
computes how many grid points it exceeds (a 50-element array filter), rows collapse
to a <= 51-bin histogram per ticker, and the grid rates are read off that histogram.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings
from skewline.operators.features import stock_panel
from skewline.operators.rolling import wspec


def linspace(start: float, stop: float, num: int) -> list[float]:
    """the grid exactly as numpy builds it."""
    return [float(x) for x in np.linspace(start, stop, num)]


def horizon_sigma(rv: Column, cfg: Settings = DEFAULT) -> Column:
    """rv * sqrt(h / 252) when rv > 0, else the default window sigma."""
    return F.when(rv > 0, rv * F.lit(math.sqrt(cfg.horizon_days / cfg.trading_days))).otherwise(
        F.lit(cfg.default_sigma_window))


def forward_returns(bars: DataFrame, cfg: Settings = DEFAULT, stock: DataFrame | None = None, known: bool = False) -> DataFrame:
    """fwd_ret = ln(close[t+h] / entry[t+1]) over stock sessions; the last h+1 rows
    of each ticker are excluded, as are rows with a missing or non-positive entry.  With ``known``
    also the session on which bars up to then first give the row."""
    h = cfg.horizon_days
    sp = stock_panel(bars, cfg) if stock is None else stock
    w = wspec()
    entry = F.lead(cfg.entry_price, 1).over(w)
    exit_px = F.lead("close", h).over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    df = sp.select("date", "ticker", "close", "realized_vol_20d", entry.alias("_entry"), exit_px.alias("_exit"),
                   F.row_number().over(w).alias("_rn"), n.alias("_n"), F.lead("date", h + 1).over(w).alias("known"))
    df = df.where((F.col("_rn") <= F.col("_n") - (h + 1)) & F.col("_entry").isNotNull() & F.col("_exit").isNotNull()
                  & (F.col("_entry") > 0))
    return df.select("date", "ticker", "close", "realized_vol_20d", F.log(F.col("_exit") / F.col("_entry")).alias(
        "fwd_ret"), horizon_sigma(F.col("realized_vol_20d"), cfg).alias("sigma"), *(["known"] if known else []))


def calibrate_k(returns: DataFrame, cfg: Settings = DEFAULT, key="ticker") -> DataFrame:
    """A5: per key (a column or several), the smallest grid k with |mean(|r| > k sigma) - 0.30| < 0.05 over valid rows
    (sigma > 0, finite r); fewer than 50 rows or no such k gives the default 1.5."""
    key = [key] if isinstance(key, str) else list(key)
    lo, hi, num = cfg.k_grid
    grid = F.array(*[F.lit(x) for x in linspace(lo, hi, num)])
    r, s = F.col("fwd_ret"), F.col("sigma")
    valid = (s > 0) & r.isNotNull() & ~F.isnan(r) & (F.abs(r) != float("inf")) & ~F.isnan(s)
    m = F.size(F.filter(grid, lambda k: F.abs(r) > k * s))
    per_row = returns.select(*key, F.when(valid, m).alias("_m"))
    hist = per_row.groupBy(*key, "_m").agg(F.count(F.lit(1)).alias("_c"))
    per_key = hist.groupBy(*key).agg(
        F.sum("_c").alias("n_rows"),
        F.sum(F.when(F.col("_m").isNotNull(), F.col("_c"))).alias("n_valid"),
        F.collect_list(F.when(F.col("_m").isNotNull(), F.struct(F.col("_m").alias("m"), F.col("_c").alias("c"))))
        .alias("_h"),
    )
    nv = F.when(F.col("n_valid") > 0, F.col("n_valid"))
    rates = F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda j: F.aggregate(
        F.filter(F.col("_h"), lambda b: b["m"] > j), F.lit(0).cast("bigint"), lambda acc, b: acc + b["c"]).cast("double") / nv)
    hit = F.array_position(F.transform(rates, lambda x: F.abs(x - F.lit(cfg.base_rate_target)) < F.lit(0.05)), True)
    k = F.when((F.col("n_rows") >= 50) & (F.coalesce(nv, F.lit(0)) >= 50) & (hit > 0),
               F.element_at(grid, hit.cast("int"))).otherwise(F.lit(cfg.default_k_threshold))
    return per_key.select(*key, k.alias("k"), F.coalesce(nv, F.lit(0)).cast("bigint").alias("n_valid"))


def label_targets(df: DataFrame, k: DataFrame, cfg: Settings = DEFAULT, key: str = "ticker") -> DataFrame:
    """y_magnitude = |r| > k sigma, y_direction = r > 0; k from ``k`` (J-KEY default 1.5)."""
    out = df.join(k.select(key, "k"), key, "left").withColumn(
        "k", F.coalesce(F.col("k"), F.lit(cfg.default_k_threshold)))
    return out.withColumn("threshold", F.col("k") * F.col("sigma")).withColumn(
        "y_magnitude", (F.abs(F.col("fwd_ret")) > F.col("threshold")).cast("int")).withColumn(
        "y_direction", (F.col("fwd_ret") > 0).cast("int"))


def training_frame(features: DataFrame, bars: DataFrame, cfg: Settings = DEFAULT, as_of=None,
                   stock: DataFrame | None = None) -> DataFrame:
    """M1: features joined to stock bars and forward targets over the trailing
    2 years + 30 days up to ``as_of`` (default: latest feature date); k is calibrated on
    the frame's own rows."""
    fr = forward_returns(bars, cfg, stock)
    df = features.join(fr.withColumnRenamed("close", "stock_close"), ["date", "ticker"], "inner")
    days = 365 * cfg.training_window_years + 30
    # scalar subquery: a partial max per task, then one value; no single-partition window
    end = features.select(F.max("date")).scalar() if as_of is None else F.lit(as_of).cast("date")
    df = df.where(F.col("date") >= F.date_sub(end, days))
    k = calibrate_k(df, cfg)
    return label_targets(df, k, cfg)
