"""Sources, keyed writes and sinks."""

import json

from pyspark.sql import functions as F

from skewline.functions.text import redact_secrets
from skewline.sources import market_data as M
from skewline.sources import tables as TB


def test_secrets_removed_from_url(spark):
    df = spark.createDataFrame([("https://x/v3?limit=5&apiKey=secret123&b=1",)], "url string")
    out = df.select(redact_secrets(F.col("url"), "secret123").alias("u")).collect()[0]["u"]
    assert "secret" not in out and "[REDACTED]" in out


def test_upsert_last_wins_and_idempotent(spark):
    base = spark.createDataFrame([("2024-01-02", "A", 1.0), ("2024-01-02", "B", 2.0)], "date string, ticker string, v double")
    upd = spark.createDataFrame([("2024-01-02", "A", 9.0), ("2024-01-03", "A", 3.0)], "date string, ticker string, v double")
    once = TB.upsert(base, upd, ["date", "ticker"])
    twice = TB.upsert(once, upd, ["date", "ticker"])
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    assert ("2024-01-02", "A", 9.0) in a and len(a) == 3


def test_update_from_null_overwrites_unmatched_kept(spark):
    base = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "k string, v double")
    upd = spark.createDataFrame([("A", None)], "k string, v double")
    got = dict(map(tuple, TB.update_from(base, upd, ["k"], ["v"]).collect()))
    assert got == {"A": None, "B": 2.0}


def test_universe_normalize(spark):
    df = spark.createDataFrame([("BRK.B",), ("AAPL",), ("",), ("BAD SYM!",), ("AAPL",)], "symbol string")
    got = sorted(r.symbol for r in M.universe_normalize(df).collect())
    assert got == ["AAPL", "BRK-B"]


def test_page_metrics_later_label_wins(spark):
    html = "<p>DSPX: 12.5</p><b>COR1M</b> 33.25 and Implied Correlation: 41.75"
    r = M.page_metrics(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()[0]
    assert r["dspx"] == 12.5 and r["cor1m"] == 41.75


def test_watchlist_json_and_markdown_name_the_ticker(spark):
    from skewline.plans import sinks as SK

    sig = spark.createDataFrame(
        [("2024-05-24", 1, "NVDA", 2.1, 0.68, 0.31, 0.5, 0.55, 0.45, "SHORT", "medium", 5.1)],
        "date string, rank int, ticker string, activity_score double, p_magnitude double, p_up double, "
        "iv_baseline_p double, long_threshold double, short_threshold double, signal string, confidence string, "
        "threshold_pct double").withColumn("date", F.to_date("date")).withColumn(
        "marginal_lift", F.col("p_magnitude") - F.col("iv_baseline_p")).withColumn(
        "top_features", F.array(F.lit("iv_atm_30dte"))).withColumn("leakage_caveats", F.array(F.lit("earnings")))
    fun = spark.createDataFrame([("2024-05-24", 100, 40, 12, 3)], "date string, universe_size long, after_exclusions long, "
                                "candidates_screened long, magnitude_passes long").withColumn("date", F.to_date("date"))
    mkt = spark.createDataFrame([("2024-05-24", 20.0, None, None)], "date string, vix double, vix3m double, dspx double"
                                ).withColumn("date", F.to_date("date"))
    mf = spark.createDataFrame([("2024-05-24", None, None)], "date string, z_vix_3d_change double, "
                               "z_hy_oas_5d_change double").withColumn("date", F.to_date("date"))
    payload = json.loads(SK.watchlist(sig, fun, mkt, mf, None, F.lit("t")).collect()[0]["payload"])
    assert payload["signals"][0]["ticker"] == "NVDA" and payload["market"]["regime"] == "normal"
    md = SK.watchlist_markdown(sig, fun, mkt).collect()[0]["markdown"]
    assert "NVDA" in md and "Caveat: earnings" in md


def test_exclusion_order_with_dividends(spark):
    from skewline.config import DEFAULT
    from skewline.operators import screen as S

    day = "2024-01-10"
    panel = spark.createDataFrame([(day, t) for t in "ABC"], "d string, ticker string").select(F.to_date("d").alias("date"), "ticker")
    bars = spark.createDataFrame([(f"2023-{1 + i // 28:02d}-{1 + i % 28:02d}", t, 1.0) for i in range(300) for t in "ABC" if i < 300],
                                 "d string, ticker string, close double").select(F.to_date("d").alias("date"), "ticker", "close")
    bars = bars.unionByName(panel.withColumn("close", F.lit(1.0)))
    options = spark.createDataFrame([(day, t, 900.0) for t in "ABC"], "d string, underlying string, volume double").select(
        F.to_date("d").alias("date"), "underlying", "volume")
    near = lambda t, d: spark.createDataFrame([(t, d)], "ticker string, d string").select("ticker", F.to_date("d").alias("event_date"))
    events, dividends = near("A", "2024-01-13"), near("A", "2024-01-10").union(near("B", "2024-01-06"))
    got = {r.ticker: r.reason for r in S.exclusions(panel, bars, options, DEFAULT, events, dividends).collect()}
    assert got == {"A": "earnings_window", "B": "ex_dividend_window", "C": None}


def test_wide_bars_with_a_missing_field(spark):
    from skewline.sources import market_data as M

    wide = spark.createDataFrame([("2024-01-02", 1.0, 2.0, None)], "date string, A_open double, A_close double, B_close double")
    got = {r.ticker: (r.open, r.close, r.volume) for r in M.ohlcv_wide_to_long(wide, ["A", "B", "C"]).collect()}
    assert got == {"A": (1.0, 2.0, None)}
