"""Health monitoring: one set of warning rules (A21) for every date, the health block and the monthly report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.config import DEFAULT, FEATURE_NAMES, Settings
from skewline.functions.numeric import round_half_up
from skewline.operators import stats as ST

# Sums of probabilities are taken in fixed point: exact, so they don't depend on row order.
EXACT = "decimal(18,9)"


def trailing(daily: DataFrame, days: int = 30) -> DataFrame:
    """Per-day rows copied to every window end within ``days`` days after them (a fixed
    fan-out), as column ``end``."""
    return daily.withColumn("end", F.explode(F.sequence(F.col("date"), F.date_add("date", days)))).drop("date")


def calibration_bins(scored: DataFrame) -> DataFrame:
    """(end, decile, n, sum_p, sum_y) of the 30 days up to each day."""
    b = F.least(F.floor(F.col("p_magnitude") * F.lit(10.0)), F.lit(9)).cast("int")
    daily = scored.where(F.col("p_magnitude").isNotNull() & F.col("y_magnitude").isNotNull()).groupBy("date", b.alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("p_magnitude").cast(EXACT)).alias("sum_p"),
        F.sum(F.col("y_magnitude").cast(EXACT)).alias("sum_y"))
    return trailing(daily).groupBy("end", "decile").agg(*[F.sum(c).alias(c) for c in ("n", "sum_p", "sum_y")])


def hits(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """LONG and SHORT signals with ``hit`` (null where the outcome is not known) and lift."""
    s = signals.where(F.col("signal").isin("LONG", "SHORT")).select("date", "ticker", "signal", "p_magnitude", "iv_baseline_p").join(
        outcomes.select("date", "ticker", "y_direction"), ["date", "ticker"], "left")
    up = F.col("y_direction") == 1
    return s.withColumn("hit", F.when(F.col("signal") == "LONG", up).otherwise(~up).cast("int"))


def direction_hits(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(end, signal, n, known, hits, lift) of LONG and SHORT signals in the 30 days up to each day."""
    daily = hits(signals, outcomes).groupBy("date", "signal").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("known"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"),
        F.sum((F.col("p_magnitude") - F.col("iv_baseline_p")).cast(EXACT)).alias("lift"))
    return trailing(daily).groupBy("end", "signal").agg(*[F.sum(c).alias(c) for c in ("n", "known", "hits", "lift")])


def warnings_by_date(signals: DataFrame, outcomes: DataFrame, features: DataFrame, dates: DataFrame, cfg: Settings = DEFAULT,
                     drift_cols=FEATURE_NAMES) -> DataFrame:
    """(date, kind, subject, value, warning) for every date of ``dates``, from the 30 days (drift: the
    year) up to it: hit rate of ten known signals or more below 0.50, and the low end of its 80 % interval
    too; feature drift alert or pause; mean lift of 20 signals or more over the IV baseline below 0.02;
    calibration error above 0.10 in three or more probability bins."""
    ends = dates.select(F.col("date").alias("end")).distinct()
    sums = direction_hits(signals, outcomes).join(ends, "end", "left_semi")
    low = sums.where((F.col("known") >= 10) & (F.col("hits") / F.col("known") < cfg.hit_rate_min))
    # Only days that a low rate looks back on are drawn for.
    days = low.select(F.explode(F.sequence(F.date_sub("end", 30), F.col("end"))).alias("date"), "signal").distinct()
    ci = ST.trailing_ci(hits(signals, outcomes).join(days, ["date", "signal"], "left_semi"), "hit", ["date", "ticker"], "signal", seed=cfg.seed)
    low = low.join(ci, ["end", "signal"]).where(F.col("lo") < cfg.hit_rate_min).select(
        F.col("end").alias("date"), F.lit("hit_rate").alias("kind"), F.col("signal").alias("subject"), (F.col("hits") / F.col("known")).alias("value"),
        F.format_string("%s hit rate below minimum", "signal").alias("warning"))
    ks = ST.ks_by_date(features, drift_cols, dates, cfg).where(F.col("severity") != "ok").select(
        "date", F.lit("drift").alias("kind"), F.col("feature").alias("subject"), F.col("ks").alias("value"),
        F.format_string("Feature drift %s: %s KS=%.3f", "severity", "feature", round_half_up(F.col("ks"), 3)).alias("warning"))
    lift = sums.groupBy("end").agg(F.sum("n").alias("n"), (F.sum("lift").cast("double") / F.sum("n")).alias("lift"))
    weak = lift.where((F.col("n") >= 20) & (F.col("lift") < cfg.marginal_auc_min)).select(
        F.col("end").alias("date"), F.lit("marginal_lift").alias("kind"), F.lit("stage_b").alias("subject"), F.col("lift").alias("value"),
        F.format_string("Marginal lift below minimum (%.3f < %.2f)", round_half_up(F.col("lift"), 3), F.lit(cfg.marginal_auc_min)).alias("warning"))
    error = F.abs(F.col("sum_p").cast("double") - F.col("sum_y").cast("double")) / F.col("n")
    bins = calibration_bins(outcomes).join(ends, "end", "left_semi").groupBy("end").agg(
        F.sum((error > cfg.calibration_error_max).cast("int")).alias("b"))
    off = bins.where(F.col("b") >= 3).select(
        F.col("end").alias("date"), F.lit("calibration").alias("kind"), F.lit("stage_b").alias("subject"), F.col("b").cast("double").alias("value"),
        F.format_string("Calibration error above %.2f in %d deciles", F.lit(cfg.calibration_error_max), "b").alias("warning"))
    return low.unionByName(ks).unionByName(weak).unionByName(off)


def warning_lists(warnings: DataFrame) -> DataFrame:
    """(date, warnings): the sorted texts of each date (at most one a rule and subject)."""
    return warnings.groupBy("date").agg(F.sort_array(F.collect_list("warning")).alias("warnings"))


def pause_warnings(signals: DataFrame, outcomes: DataFrame, features: DataFrame, as_of: Column, cfg: Settings = DEFAULT,
                   drift_cols=FEATURE_NAMES) -> DataFrame:
    """The warnings active on one date, a column without references (a literal or a scalar subquery)."""
    dates = signals.sparkSession.range(1).select(as_of.alias("date"))
    return warnings_by_date(signals, outcomes, features, dates, cfg, drift_cols).drop("date")


def health(scored: DataFrame, warnings: DataFrame) -> DataFrame:
    """(date, calibration_error, warnings) for the health block: expected calibration error
    over ten bins of the 30 days up to each day, and the active warnings."""
    error = calibration_bins(scored).groupBy("end").agg((F.sum(F.abs(F.col("sum_p") - F.col("sum_y"))).cast("double") / F.sum("n")).alias("calibration_error"))
    return error.withColumnRenamed("end", "date").join(warning_lists(warnings), "date", "full")
