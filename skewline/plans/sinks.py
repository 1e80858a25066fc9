"""Output sinks: nested JSON watchlist (S13), markdown watchlist (S14), monthly
monitoring report (S15).  One row per date (or month); lists inside a row are
bounded by the dynamic top-N (<= 25 signals).  Headings and labels are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings
from skewline.functions.numeric import round_half_up
from skewline.operators.stats import market_regime
from skewline.plans import monitor as MO

def fmt(c: Column, digits: int) -> Column:
    """Fixed-point text: rounded half up first, so no tie is left to the formatter."""
    return F.format_string(f"%.{digits}f", round_half_up(c, digits))


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def signal_struct(sig: DataFrame) -> DataFrame:
    """Payload entry per signal (rounded as published) with its candidate rank."""
    r = round_half_up
    return sig.select("date", "rank", F.struct(
        F.col("ticker"), r(F.col("activity_score"), 2).alias("activity_score"),
        r(F.col("p_magnitude"), 3).alias("p_magnitude"), r(F.col("iv_baseline_p"), 3).alias("iv_baseline_p"),
        r(F.col("marginal_lift"), 3).alias("marginal_lift"), r(F.col("p_up"), 3).alias("p_up"),
        r(F.col("long_threshold"), 3).alias("long_threshold"), r(F.col("short_threshold"), 3).alias("short_threshold"),
        F.col("signal"), F.col("confidence"), r(F.col("threshold_pct"), 1).alias("threshold_pct"),
        F.col("top_features"), F.col("leakage_caveats")).alias("s"))


def watchlist(signals: DataFrame, funnel: DataFrame, market: DataFrame, market_feats: DataFrame,
              auc_lift: DataFrame | None = None, generated_at: Column | None = None, health: DataFrame | None = None,
              refits: DataFrame | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """(date, n_signals, payload) - the nested watchlist document of every screened date.

    ``signals`` are scored candidates with their ``rank``; NO_DIRECTION is left out.  ``health``
    has calibration_error and warnings per date (see ``monitor.health``), ``refits`` the stamp of the
    model in use and the next refit (see ``walkforward.model_at``)."""
    per = signal_struct(signals.where(F.col("signal") != "NO_DIRECTION")).groupBy("date").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]).alias("signals"))
    df = funnel.join(market.select("date", "vix", "vix3m", "dspx"), "date", "left").join(
        market_feats.select("date", "z_vix_3d_change", "z_hy_oas_5d_change"), "date", "left").join(per, "date", "left")
    if auc_lift is not None:
        df = df.join(auc_lift.select("date", "auc_lift"), "date", "left")
    else:
        df = df.withColumn("auc_lift", F.lit(None).cast("double"))
    if health is not None:
        df = df.join(health.select("date", "calibration_error", "warnings"), "date", "left")
    else:
        df = df.withColumns({"calibration_error": F.lit(None).cast("double"), "warnings": F.lit(None).cast("array<string>")})
    if refits is not None:
        df = df.join(refits.select("date", "stamp", "next_refit"), "date", "left")
    else:
        df = df.withColumns({"stamp": F.lit(None).cast("date"), "next_refit": F.lit(None).cast("date")})
    vix = F.when(_truthy(F.col("vix")), F.col("vix")).otherwise(F.lit(20.0))
    d = F.date_format("date", "yyyy-MM-dd")
    gen = generated_at if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    sigs = F.coalesce(F.col("signals"), F.array().cast(per.schema["signals"].dataType))
    payload = F.struct(
        d.alias("date"), gen.alias("generated_at"),
        F.struct(market_regime(F.col("vix")).alias("regime"), vix.alias("vix"),
                 F.when(_truthy(F.col("vix3m")), F.col("vix3m")).alias("vix3m"),
                 round_half_up(F.col("z_vix_3d_change"), 3).alias("vix_3d_change_zscore"),
                 F.when(_truthy(F.col("dspx")), F.col("dspx")).alias("dspx"),
                 round_half_up(F.col("z_hy_oas_5d_change"), 3).alias("hy_oas_5d_change_zscore")).alias("market"),
        F.struct("universe_size", "after_exclusions", "candidates_screened", "magnitude_passes").alias("screening"),
        sigs.alias("signals"),
        F.struct(round_half_up(F.col("auc_lift"), 3).alias("iv_baseline_auc_lift_30d"),
                 round_half_up(F.col("calibration_error"), 3).alias("stage_b_calibration_error_30d"),
                 F.date_format("stamp", "yyyy-MM-dd").alias("last_refit"), F.date_format("next_refit", "yyyy-MM-dd").alias("next_refit"),
                 F.coalesce("warnings", F.array().cast("array<string>")).alias("pause_warnings")).alias("health"))
    return df.select("date", F.size(sigs).cast("bigint").alias("n_signals"),
                     F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def _md_signal_blocks(signals: DataFrame) -> DataFrame:
    s = signal_struct(signals.where(F.col("signal") != "NO_DIRECTION")).select("date", "rank", "s.*")
    p_up = F.col("p_up")
    block = F.concat_ws(
        "\n",
        F.format_string("### %s — %s ● %s confidence", "ticker", "signal", "confidence"),
        F.concat(F.lit("Move probability: "), fmt(F.col("p_magnitude") * F.lit(100.0), 0), F.lit("% | Direction: "),
                 F.when(p_up > 0.5, "up").otherwise("down"), F.lit(" (p_up="), fmt(p_up, 2), F.lit(")")),
        F.concat(F.lit("Stock-adjusted threshold: ±"), fmt(F.col("threshold_pct"), 1), F.lit("% over 5 days")),
        F.concat(F.lit("Key drivers: "), F.array_join(F.slice("top_features", 1, 3), ", ")),
        F.when(F.size("leakage_caveats") > 0,
               F.concat(F.lit("⚠️ Caveat: "), F.array_join("leakage_caveats", ", "))),
        F.lit(""),
    )
    return s.groupBy("date").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]),
                     "\n").alias("blocks"), F.count(F.lit(1)).alias("n_sig"))


def watchlist_markdown(signals: DataFrame, funnel: DataFrame, market: DataFrame) -> DataFrame:
    """The watchlist rendered as markdown, one document per date."""
    blocks = _md_signal_blocks(signals)
    df = funnel.join(market.select("date", "vix", "dspx"), "date", "left").join(blocks, "date", "left")
    vix = F.when(_truthy(F.col("vix")), F.col("vix")).otherwise(F.lit(20.0))
    dspx_part = F.when(_truthy(F.col("dspx")), F.concat(F.lit(" | DSPX "), fmt(F.col("dspx"), 1))).otherwise("")
    n_sig = F.coalesce(F.col("n_sig"), F.lit(0))
    body = F.when(n_sig > 0, F.col("blocks")).otherwise(F.lit("*No signals today.*"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Watchlist — "), F.date_format("date", "yyyy-MM-dd")), F.lit(""),
        F.concat(F.lit("**Market:** "), F.upper(market_regime(F.col("vix"))), F.lit(" (VIX "), fmt(vix, 1),
                 F.lit(")"), dspx_part), F.lit(""),
        F.format_string("Screened: %d stocks → %d candidates → %d magnitude passes → %d signals",
                        F.col("after_exclusions"), F.col("candidates_screened"), F.col("magnitude_passes"), n_sig),
        F.lit(""), F.lit("---"), F.lit(""), F.lit("## Signals"), F.lit(""), body,
        F.lit("---"), F.lit(""), F.lit("## System health"), F.lit("See monitoring/ for full monthly report."))
    return df.select("date", text.alias("markdown"))


def monthly_report(signals: DataFrame, outcomes: DataFrame, features: DataFrame, cfg: Settings = DEFAULT,
                   generated_at: Column | None = None) -> DataFrame:
    """S15 per month: signal count and, as of the month's end, the active warnings (the rules of
    ``monitor.warnings_by_date``), the calibration table (ten probability bins) and the hit rates, as markdown.

    ``outcomes`` holds p_magnitude, y_magnitude and y_direction per (date, ticker)."""
    counts = signals.groupBy(F.date_format("date", "yyyy-MM").alias("ym")).agg(
        F.count(F.lit(1)).alias("total_signals"), F.last_day(F.max("date")).alias("end"))
    hits, bins = MO.direction_hits(signals, outcomes).where("known > 0"), MO.calibration_bins(outcomes)
    ends = counts.select(F.col("end").alias("date"))
    active = MO.warning_lists(MO.warnings_by_date(signals, outcomes, features, ends, cfg)).withColumnRenamed("date", "end")
    bin_row = F.concat(F.lit("| "), F.col("decile").cast("string"), F.lit(" | "), F.col("n").cast("string"), F.lit(" | "),
                       fmt(F.col("sum_p").cast("double") / F.col("n"), 3), F.lit(" | "), fmt(F.col("sum_y").cast("double") / F.col("n"), 3), F.lit(" |"))
    hit_row = F.concat(F.lit("| "), F.col("signal"), F.lit(" | "), F.col("known").cast("string"), F.lit(" | "),
                       fmt(F.col("hits") / F.col("known"), 3), F.lit(" |"))

    def table(rows: DataFrame, order: str, line: Column, out: str) -> DataFrame:
        listed = rows.groupBy("end").agg(F.sort_array(F.collect_list(F.struct(order, line.alias("l")))).alias("r"))  # <= 10 rows
        return listed.select("end", F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias(out))

    df = (counts.join(active, "end", "left").join(table(bins, "decile", bin_row, "bins"), "end", "left")
          .join(table(hits, "signal", hit_row, "hits"), "end", "left")
          .withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>"))))
    gen = generated_at if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    listed = F.when(F.size("warnings") > 0, F.concat(
        F.lit("## Active Warnings\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- ⚠️ "), w)), "\n"),
        F.lit("\n\n"))).otherwise(F.lit(""))
    none = F.lit("No outcomes in the last 30 days.")
    text = F.concat(
        F.lit("# Monitoring Report — "), F.col("ym"), F.lit("\n\nGenerated: "), gen, F.lit("\n\n## Summary\n\n"),
        F.format_string("- Total signals: %d\n- Pause warnings: %d\n\n", F.col("total_signals"), F.size("warnings")), listed,
        F.lit("## Stage B Calibration\n"),
        F.coalesce(F.concat(F.lit("| Bin | Rows | Predicted | Realized |\n|---|---|---|---|\n"), F.col("bins")), none),
        F.lit("\n\n## Stage C Hit Rates\n"),
        F.coalesce(F.concat(F.lit("| Signal | Rows | Hit rate |\n|---|---|---|\n"), F.col("hits")), none), F.lit("\n"))
    return df.select(F.col("ym").alias("year_month"), F.col("total_signals").cast("bigint").alias("total_signals"),
                     F.size("warnings").cast("bigint").alias("n_warnings"), text.alias("report"))


def write_documents(df: DataFrame, key: str, text: str, root: str) -> None:
    """File sink: one text file per ``key`` (a date or month) under ``root/<key>=...``;
    writing a key again replaces its file and leaves the others."""
    (df.select(key, F.col(text).alias("value")).repartition(key).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy(key).text(root))


def read_documents(spark, key: str, root: str) -> DataFrame:
    """(key, text) of the files written by ``write_documents``."""
    return spark.read.text(root, wholetext=True).select(F.col(key), F.regexp_replace("value", "\n$", "").alias("text"))
