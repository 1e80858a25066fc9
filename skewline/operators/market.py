"""Market-level series: index z-scores (W7, W8, J-CARRY) and the per-date market row.

The market table has one row per session and no partition key, so its windows
run in a single task.  Its size is the calendar (about 252 rows a year), not the
data volume; that bound is what makes the single partition acceptable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings
from skewline.operators.rolling import rolling_z


def _calendar_window(order="date"):
    return Window.orderBy(order)  # single partition: one row per session, see module note


def obs_change_z(market: DataFrame, col: str, lag: int, out: str, cfg: Settings = DEFAULT) -> DataFrame:
    """On the non-null observations of ``col``: change over ``lag`` observations, then its
    rolling z (252 rows, >= 60 values).  Also returns the running observation count."""
    w = _calendar_window()
    obs = market.select("date", col).where(F.col(col).isNotNull())
    obs = obs.withColumn("_chg", F.col(col) - F.lag(col, lag).over(w))
    obs = obs.withColumn("_nobs", F.count(col).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    z = rolling_z(F.col("_chg"), w, cfg.rolling_window, cfg.rolling_min_periods)
    # the reference also asks for more than 60 observations in the whole history
    return obs.select("date", F.when(F.col("_nobs") > cfg.rolling_min_periods, z).alias(out))


def market_features(market: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Per market date: levels (exact date), VIX 3-obs change z (needs that day's VIX) and
    HY OAS 5-obs change z carried from the latest OAS observation on or before the date."""
    zv = obs_change_z(market, "vix", 3, "z_vix_3d_change", cfg)
    zo = obs_change_z(market, "hy_oas", 5, "_z_oas", cfg).withColumn("_oas_obs", F.struct("_z_oas"))
    m = market.join(zv, "date", "left").join(zo, "date", "left")
    w = _calendar_window().rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last("_oas_obs", ignorenulls=True).over(w)
    return m.select(
        "date",
        F.col("vix").alias("vix_level"),
        F.col("vix3m").alias("vix3m_level"),
        F.col("dspx").alias("dspx_level"),
        F.col("cor1m").alias("cor1m_level"),
        F.when(F.col("vix").isNotNull() & (F.col("vix") != 0), F.col("z_vix_3d_change")).alias("z_vix_3d_change"),
        carried.getField("_z_oas").alias("z_hy_oas_5d_change"),
    )
