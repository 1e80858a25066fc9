"""Stage A screening for every (date, ticker) at once: exclusions (P12, P13, A2, A3, F8),
activity score (W10, F12), benchmark-relative score (J-BENCH), dynamic top-N (T2)
and the funnel counts (A12).

The screening panel is the set of (date, ticker) stock bars of universe tickers:
a ticker is screened on the sessions where it traded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings
from skewline.operators.rolling import nonnull_rows_z, wspec


def third_friday(d: Column) -> Column:
    """F8: third Friday of d's month = first Friday on/after the 1st, plus 14 days."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(d, "month"), 1), "Fri"), 14)


def in_opex_window(d: Column, buffer_days: int) -> Column:
    return F.abs(F.datediff(d, third_friday(d))) <= buffer_days


def screening_panel(bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return bars.select("date", "ticker").where(F.col("ticker") != cfg.benchmark_ticker)


def history_depth(bars: DataFrame) -> DataFrame:
    """A2: number of stock rows of the ticker up to and including the date."""
    w = wspec().rowsBetween(Window.unboundedPreceding, 0)
    return bars.select("date", "ticker", F.count(F.lit(1)).over(w).alias("history_depth"))


def option_volume_20d(panel: DataFrame, options: DataFrame, window_days: int = 20) -> DataFrame:
    """A3: mean option volume per contract row over (d - 20 days, d] for each panel row.

    Options are first reduced to one (sum, count) row per (ticker, day) - a partial
    aggregate - then merged with the panel on one ticker timeline and summed over a
    RANGE frame of calendar days.  No per-date look-back query.
    """
    daily = options.groupBy(F.col("underlying").alias("ticker"), "date").agg(
        F.sum("volume").alias("_vs"), F.count("volume").alias("_vn"))
    tl = panel.select("date", "ticker", F.lit(1).alias("_eval")).unionByName(
        daily.withColumn("_eval", F.lit(0)), allowMissingColumns=True
    ).withColumn("_day", F.unix_date("date"))
    w = Window.partitionBy("ticker").orderBy("_day").rangeBetween(-(window_days - 1), 0)
    s, n = F.sum("_vs").over(w), F.sum("_vn").over(w)
    out = tl.select("date", "ticker", "_eval", F.when(n > 0, s / n).alias("avg_option_volume_20d"))
    return out.where(F.col("_eval") == 1).drop("_eval")


def event_window_days(events: DataFrame, buffer_days: int) -> DataFrame:
    """P13 helper: each event expanded to the calendar days within +-buffer (exact range
    join as an equi-join on (ticker, date); 2*buffer+1 rows per event)."""
    days = F.explode(F.sequence(F.date_sub("event_date", buffer_days), F.date_add("event_date", buffer_days)))
    return events.select("ticker", days.alias("date")).distinct()


def event_window_exclusion(panel: DataFrame, events: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return panel.join(event_window_days(events, cfg.earnings_buffer_days), ["ticker", "date"], "left_semi")


def exclusions(panel: DataFrame, bars: DataFrame, options: DataFrame, cfg: Settings = DEFAULT,
               events: DataFrame | None = None, dividends: DataFrame | None = None) -> DataFrame:
    """First failing rule, in order: earnings window, ex-dividend window (both need a
    caller-supplied calendar), opex window, insufficient history, insufficient option volume."""
    df = panel.join(history_depth(bars), ["date", "ticker"], "left").join(
        option_volume_20d(panel, options), ["date", "ticker"], "left")
    reason = F.lit(None).cast("string")
    rules = []
    for name, cal in (("earnings_window", events), ("ex_dividend_window", dividends)):
        if cal is not None:
            flag = f"_{name}"
            df = df.join(event_window_days(cal, cfg.earnings_buffer_days).withColumn(flag, F.lit(True)),
                         ["ticker", "date"], "left")
            rules.append((F.col(flag).isNotNull(), name))
    rules += [
        (in_opex_window(F.col("date"), cfg.opex_buffer_days), "opex_window"),
        (F.coalesce(F.col("history_depth"), F.lit(0)) < cfg.min_history_days, "insufficient_history"),
        (F.col("avg_option_volume_20d").isNull() | (F.col("avg_option_volume_20d") < cfg.min_option_volume_20d),
         "insufficient_option_volume"),
    ]
    expr = None
    for cond, name in rules:
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    reason = expr
    return df.select("date", "ticker", reason.alias("reason"), reason.isNull().alias("passes"))


ACTIVITY_INPUTS = ("call_put_volume_ratio", "iv_pct_rank_252d")


def activity_scores(targets: DataFrame, features: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """W10 + F12 at each (date, ticker) of ``targets``: z of the latest non-null value among
    the last <= 252 non-null feature rows up to the date (fewer than 20 -> 0), then
    0.5 z_cp + 0.3 z_ivrank + 0.2 z_ivrv.

    Each input column's z is computed on its own non-null rows with O(n) prefix sums;
    the three z streams and the target rows then share one per-ticker timeline where
    the latest z is carried forward (a feature row sorts before a target row of the
    same date)."""
    cols = ACTIVITY_INPUTS + (cfg.activity_rv_column,)
    zs = [nonnull_rows_z(features, c, f"_z{i}", window=cfg.rolling_window, min_periods=cfg.screen_z_min_periods)
          for i, c in enumerate(cols)]
    tl = targets.select("date", "ticker", F.lit(1).alias("_eval"))
    for z in zs:
        tl = tl.unionByName(z.withColumn("_eval", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("date", "_eval").rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.coalesce(F.last(f"_z{i}", ignorenulls=True).over(w), F.lit(0.0)).alias(f"_z{i}")
               for i in range(len(cols))]
    out = tl.select("date", "ticker", "_eval", *carried).where(F.col("_eval") == 1)
    score = F.lit(0.5) * F.col("_z0") + F.lit(0.3) * F.col("_z1") + F.lit(0.2) * F.col("_z2")
    return out.select("date", "ticker", F.col("_z0").alias("z_cp"), F.col("_z1").alias("z_iv_rank"),
                      F.col("_z2").alias("z_iv_rv"), score.alias("activity_score"))


def relative_scores(panel: DataFrame, features: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """J-BENCH: score minus the benchmark's score on the same date (0 without history)."""
    bench_dates = panel.select("date").distinct().withColumn("ticker", F.lit(cfg.benchmark_ticker))
    scores = activity_scores(panel.unionByName(bench_dates), features, cfg)
    bench = scores.where(F.col("ticker") == cfg.benchmark_ticker).select(
        "date", F.col("activity_score").alias("_bench"))
    uni = scores.where(F.col("ticker") != cfg.benchmark_ticker)
    return uni.join(bench, "date", "left").select(
        "date", "ticker", "activity_score",
        (F.col("activity_score") - F.coalesce(F.col("_bench"), F.lit(0.0))).alias("score_rel"))


def stage_a_n(vix: Column, cfg: Settings = DEFAULT) -> Column:
    """n = min(int(5 + 5 * clip(vix / 20, 0.5, 2)), 25); VIX missing or 0 -> 20."""
    v = F.when(vix.isNull() | (vix == 0), F.lit(20.0)).otherwise(vix)
    factor = F.least(F.greatest(v / F.lit(20.0), F.lit(0.5)), F.lit(2.0))
    n = F.floor(F.lit(float(cfg.stage_a_base)) + F.lit(float(cfg.stage_a_slope)) * factor)
    return F.least(n, F.lit(cfg.stage_a_max)).cast("int")


def stage_a(panel: DataFrame, bars: DataFrame, options: DataFrame, features: DataFrame, market: DataFrame,
            cfg: Settings = DEFAULT, events: DataFrame | None = None) -> DataFrame:
    """All screened rows with reason, score and candidate rank; ``candidate`` marks the top-N."""
    ex = exclusions(panel, bars, options, cfg, events)
    rel = relative_scores(panel, features, cfg)
    n = market.select("date", stage_a_n(F.col("vix"), cfg).alias("n_select"))
    df = ex.join(rel, ["date", "ticker"], "left").join(n, "date", "left").withColumn(
        "n_select", F.coalesce(F.col("n_select"), stage_a_n(F.lit(None).cast("double"), cfg)))
    w = Window.partitionBy("date").orderBy(F.col("passes").desc(), F.col("score_rel").desc(), F.col("ticker"))
    rank = F.when(F.col("passes"), F.row_number().over(w))
    df = df.withColumn("rank", rank)
    return df.withColumn("candidate", F.coalesce(F.col("rank") <= F.col("n_select"), F.lit(False)))


def funnel(screen: DataFrame, magnitude: DataFrame | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """A12 per date: universe size, after exclusions, candidates, magnitude passes."""
    df = screen
    mag = F.lit(0)
    if magnitude is not None:
        df = df.join(magnitude.select("date", "ticker", "p_magnitude"), ["date", "ticker"], "left")
        mag = F.count_if(F.col("candidate") & (F.col("p_magnitude") >= cfg.stage_b_threshold))
    return df.groupBy("date").agg(
        F.count(F.lit(1)).alias("universe_size"),
        F.count_if("passes").alias("after_exclusions"),
        F.count_if("candidate").alias("candidates_screened"),
        mag.cast("bigint").alias("magnitude_passes"),
    )
