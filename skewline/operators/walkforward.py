"""What each refit may know, and which refit a date is scored by (M10, M11, S16, A5 and A6 as of each refit).

Refits are stamped on the first day of every ``refit_frequency_months`` months.  A row of the
training frame serves the stamps after the session on which its outcome is known and no later
than the trailing training window, at most nine with quarterly refits; so the parameters
of all stamps come from one pass over the rows, and no row serves an earlier stamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings
from skewline.operators import stats as ST
from skewline.operators import targets as TG

MIN_TRAINING_ROWS = 200


def window_days(cfg: Settings = DEFAULT) -> int:
    return 365 * cfg.training_window_years + 30


def period_start(date: Column, cfg: Settings = DEFAULT) -> Column:
    """First day of the refit period that holds a date."""
    months = F.year(date) * 12 + F.month(date) - 1
    start = months - F.pmod(months, F.lit(cfg.refit_frequency_months))
    return F.make_date(F.floor(start / 12).cast("int"), F.pmod(start, F.lit(12)).cast("int") + 1, F.lit(1))


def rows_by_stamp(rows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Rows with ``date`` and ``known``, once for every ``stamp`` that learns from them (stamps up to the
    period of the last known row)."""
    step = F.expr(f"interval {cfg.refit_frequency_months} months")
    first = F.add_months(period_start(F.col("known"), cfg), cfg.refit_frequency_months)
    last = F.least(F.date_add("date", window_days(cfg)), rows.select(F.add_months(F.max("known"), cfg.refit_frequency_months)).scalar())
    return (rows.withColumn("_first", first).withColumn("_last", last).where(F.col("_first") <= F.col("_last"))
            .withColumn("stamp", F.explode(F.sequence("_first", "_last", step))).drop("_first", "_last"))


def registry(by_stamp: DataFrame, min_rows: int = MIN_TRAINING_ROWS) -> DataFrame:
    """stamp, n_rows, first_date and last_known of the refits with enough rows."""
    return by_stamp.groupBy("stamp").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
                                         F.max("known").alias("last_known")).where(F.col("n_rows") >= min_rows)


def k_by_stamp(by_stamp: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """A5 at every refit: stamp, ticker, k, n_valid."""
    return TG.calibrate_k(by_stamp, cfg, ["stamp", "ticker"])


def thresholds_by_stamp(scores_by_stamp: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """A6 at every refit: stamp, long_threshold, short_threshold."""
    return ST.direction_thresholds(scores_by_stamp, cfg=cfg, group=["stamp"])


def model_at(dates: DataFrame, stamps: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """date, stamp (the latest on or before the date) and next_refit, for the dates that have one.
    The timeline has one row per date and refit, so its window runs in one task by design."""
    d = dates.select("date").distinct().withColumn("_asked", F.lit(True))
    timeline = d.join(stamps.select(F.col("stamp").alias("date"), "stamp"), "date", "full")
    last = F.last("stamp", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    out = timeline.select("date", "_asked", last.alias("stamp")).where(F.col("_asked") & F.col("stamp").isNotNull())
    return out.select("date", "stamp", F.add_months("stamp", cfg.refit_frequency_months).alias("next_refit"))
