"""Market and reference-data reshaping (S4-S8, J-FULL, J-LEFT, J-MERGE)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OHLCV = ("open", "high", "low", "close", "volume")

# Vendor series identifiers and the columns they fill.
INDEX_SYMBOLS = {"VIX": "vix", "VIX3M": "vix3m"}
MACRO_SERIES = {"BAMLH0A0HYM2": "hy_oas", "DGS3MO": "t_bill_3m"}
PERCENT_SERIES = ("DGS3MO",)  # delivered in percent, stored as a fraction
# Page labels in priority order; a later label overwrites an earlier one for the same key.
PAGE_LABELS = (("DSPX", "dspx"), ("COR1M", "cor1m"), ("Implied Correlation", "cor1m"))


def ohlcv_wide(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """Vendor-style wide frame: one row per date, columns ``{ticker}_{field}``."""
    return bars.groupBy("date").pivot("ticker", tickers).agg(*[F.first(f).alias(f) for f in OHLCV])


def ohlcv_wide_to_long(wide: DataFrame, tickers: list[str], fields=OHLCV) -> DataFrame:
    """Wide (date x ticker_field) to long (date, ticker, o, h, l, c, v) with ``stack`` -
    a per-row generator, no shuffle; rows whose fields are all NULL are dropped and
    tickers absent from the frame are skipped, a field a ticker lacks is NULL."""
    have = set(wide.columns)
    present = [t for t in tickers if any(f"{t}_{f}" in have for f in fields)]
    if not present:
        return wide.sparkSession.createDataFrame([], "date date, ticker string, " + ", ".join(f"{f} double" for f in fields))
    column = lambda t, f: f"`{t}_{f}`" if f"{t}_{f}" in have else "CAST(NULL AS DOUBLE)"
    args = ", ".join(f"'{t}', " + ", ".join(column(t, f) for f in fields) for t in present)
    long = wide.selectExpr("date", f"stack({len(present)}, {args}) AS (ticker, {', '.join(fields)})")
    return long.dropna(how="all", subset=list(fields))


def market_assemble(quotes: DataFrame) -> DataFrame:
    """S5/J-FULL: index closes (date, symbol, close) to one row per date with a column per
    index; a date present in either series appears (full outer semantics) - one
    pivot, one shuffle on date."""
    p = quotes.where(F.col("symbol").isin(*INDEX_SYMBOLS)).groupBy("date").pivot("symbol", list(INDEX_SYMBOLS)).agg(
        F.max("close"))
    return p.select("date", *[F.col(s).alias(c) for s, c in INDEX_SYMBOLS.items()])


def macro_pivot_scale(obs: DataFrame) -> DataFrame:
    """Macro observations (date, series_id, value) to columns; percent series / 100;
    NaN -> NULL.  A date with only missing observations keeps a row of NULLs."""
    clean = obs.where(F.col("series_id").isin(*MACRO_SERIES)).withColumn("value", F.nanvl("value", F.lit(None)))
    p = clean.groupBy("date").pivot("series_id", list(MACRO_SERIES)).agg(F.max("value"))
    cols = []
    for sid, name in MACRO_SERIES.items():
        c = F.col(sid) / F.lit(100.0) if sid in PERCENT_SERIES else F.col(sid)
        cols.append(c.alias(name))
    return p.select("date", *cols)


def page_text(html: F.Column) -> F.Column:
    """Tag-stripped text: every tag becomes one space."""
    return F.regexp_replace(html, "<[^>]*>", " ")


def page_metrics(pages: DataFrame, html_col: str = "html", keep=("page_id",)) -> DataFrame:
    """``LABEL[:\\s]+(\\d+\\.\\d+)`` (case-insensitive, first match) for each label; a later
    label overrides an earlier one for the same key; missing -> NULL."""
    text = page_text(F.col(html_col))
    vals: dict[str, F.Column] = {}
    for label, key in PAGE_LABELS:
        m = F.nullif(F.regexp_extract(text, f"(?i){label}[:\\s]+([0-9]+\\.[0-9]+)", 1), F.lit("")).cast("double")
        vals[key] = m if key not in vals else F.coalesce(m, vals[key])
    return pages.select(*keep, *[c.alias(k) for k, c in vals.items()])


def universe_normalize(symbols: DataFrame, col: str = "symbol") -> DataFrame:
    """S8: '.' -> '-', keep symbols that are letters/digits apart from '-', distinct."""
    s = F.translate(F.col(col), ".", "-")
    ok = (s != "") & F.translate(s, "-", "").rlike("^[\\p{L}\\p{N}]+$")
    return symbols.select(s.alias("symbol")).where(ok).distinct()


def universe_from_json(df: DataFrame, col: str = "json") -> DataFrame:
    """S8 source form: a JSON array of symbols per row."""
    return df.select(F.explode(F.from_json(col, "array<string>")).alias("symbol"))


def market_daily(indices: DataFrame, macro: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """J-MERGE/J-LEFT: the market row per index date: macro series and (dated) page
    metrics left-joined on date; dates without an index close are not market dates.
    Without page metrics (historical backfill) dspx and cor1m stay NULL."""
    m = indices.join(macro, "date", "left")
    if metrics is not None:
        m = m.join(metrics.select("date", "dspx", "cor1m"), "date", "left")
    else:
        m = m.withColumn("dspx", F.lit(None).cast("double")).withColumn("cor1m", F.lit(None).cast("double"))
    return m.select("date", "vix", "vix3m", "hy_oas", "t_bill_3m", "dspx", "cor1m")
