"""Queries: sources and keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skewline import sqlcheck as Q
from skewline.functions.text import redact_secrets
from skewline.operators.chain import price_contracts
from skewline.plans.catalog import CFG, register, select_sql
from skewline.session import shared_path
from skewline.sources import market_data as M
from skewline.sources import tables as TB
from skewline.sources import vendor_json as VJ

LITERAL_KEY = "example"  # the configured key of the request-log fixture
BACKFILL_END = "1997-06-30"


@register("contracts_from_json", Q.build([], select_sql(
    ["~date AS as_of", "~ticker", "~underlying", "strike", "~expiry", "~contract_type"], "v_options").replace(
    "~date AS as_of", "date AS as_of"), views=["v_options"]))
def q_contracts_from_json(fx):
    """Contract reference pages (vendor JSON) parsed back to typed contract rows."""
    return VJ.parse_contracts(VJ.contract_payloads(fx.v_options))


@register("bars_from_json", Q.build([], select_sql(
    ["~date", "~ticker", "open", "greatest(open, close) AS high", "least(open, close) AS low", "close", "volume",
     "(open + close) / 2e0 AS vwap", "~transactions"], "v_options"), views=["v_options"]))
def q_bars_from_json(fx):
    """S3: aggregate-bar JSON (epoch-ms timestamps) parsed to typed OHLCV rows."""
    return VJ.parse_bars(VJ.bar_payloads(fx.v_options))


def _tickers(fx):
    # the universe list: a handful of symbols, small by construction
    return sorted(r[0] for r in fx.v_bars.select("ticker").distinct().collect())


@register("ohlcv_wide_to_long", Q.build([], select_sql(
    ["~date", "~ticker", "open", "high", "low", "close", "volume"], "v_bars"), views=["v_bars"]))
def q_ohlcv_wide_to_long(fx):
    """Wide (field x ticker) OHLCV frame back to long rows; empty rows dropped."""
    tickers = _tickers(fx)
    return M.ohlcv_wide_to_long(M.ohlcv_wide(fx.v_bars, tickers), tickers + ["QQQ_MISSING"])


@register("market_assemble", Q.build([
    ("vx", "SELECT date, close AS vix FROM v_index_quotes WHERE symbol = 'VIX'"),
    ("v3", "SELECT date, close AS vix3m FROM v_index_quotes WHERE symbol = 'VIX3M'"),
], select_sql(["~coalesce(vx.date, v3.date) AS date", "vix", "vix3m"], "vx FULL OUTER JOIN v3 ON vx.date = v3.date"),
    views=["v_index_quotes"]))
def q_market_assemble(fx):
    """S5/J-FULL: VIX and VIX3M series merged on date (either side may be missing)."""
    return M.market_assemble(fx.v_index_quotes)


@register("macro_pivot_scale", Q.build([], select_sql(
    ["~date", "max(CASE WHEN series_id = 'BAMLH0A0HYM2' AND NOT isnan(value) THEN value END) AS hy_oas",
     "max(CASE WHEN series_id = 'DGS3MO' AND NOT isnan(value) THEN value END) / 100e0 AS t_bill_3m"],
    "v_fred_long", "GROUP BY date"), views=["v_fred_long"]))
def q_macro_pivot_scale(fx):
    """Macro series pivoted to columns, T-bill percent -> fraction, NaN -> NULL."""
    return M.macro_pivot_scale(fx.v_fred_long)


def _label_sql(label):
    return (f"CAST(nullif(regexp_extract(regexp_replace(html, '<[^>]*>', ' ', 'g'), "
            f"'(?i){label}[:\\s]+([0-9]+\\.[0-9]+)', 1), '') AS DOUBLE)")


@register("page_metric_extract", Q.build([], select_sql(
    ["~page_id", f"{_label_sql('DSPX')} AS dspx",
     f"coalesce({_label_sql('Implied Correlation')}, {_label_sql('COR1M')}) AS cor1m"], "v_metric_pages"),
    views=["v_metric_pages"]))
def q_page_metric_extract(fx):
    """DSPX / COR1M values scraped from statistics pages (tags stripped, regex)."""
    return M.page_metrics(fx.v_metric_pages)


@register("universe_normalize", Q.build([], """
SELECT DISTINCT replace(symbol, '.', '-') AS symbol FROM v_universe_raw
WHERE replace(symbol, '.', '-') <> '' AND regexp_matches(replace(replace(symbol, '.', '-'), '-', ''), '^[\\pL\\pN]+$')""",
    views=["v_universe_raw"]))
def q_universe_normalize(fx):
    """S8: '.' -> '-', alphanumeric symbols only, distinct."""
    return M.universe_normalize(fx.v_universe_raw)


@register("universe_from_json", Q.build([], """
SELECT DISTINCT replace(symbol, '.', '-') AS symbol FROM v_universe_raw
WHERE replace(symbol, '.', '-') <> '' AND regexp_matches(replace(replace(symbol, '.', '-'), '-', ''), '^[\\pL\\pN]+$')""",
    views=["v_universe_raw"]))
def q_universe_from_json(fx):
    """S8 from its source form: JSON arrays of symbols."""
    pages = (fx.v_universe_raw.groupBy(F.pmod(F.xxhash64("symbol"), F.lit(50)).alias("page"))
             .agg(F.to_json(F.collect_list("symbol")).alias("json")))
    return M.universe_normalize(M.universe_from_json(pages))


@register("market_daily_pages", Q.build([
    ("vx", "SELECT date, close AS vix FROM v_index_quotes WHERE symbol = 'VIX'"),
    ("v3", "SELECT date, close AS vix3m FROM v_index_quotes WHERE symbol = 'VIX3M'"),
    ("ix", "SELECT coalesce(vx.date, v3.date) AS date, vix, vix3m FROM vx FULL OUTER JOIN v3 ON vx.date = v3.date"),
    ("pg", f"""
SELECT DATE '1992-01-02' + CAST(page_id AS INTEGER) AS date, {_label_sql('DSPX')} AS dspx,
  coalesce({_label_sql('Implied Correlation')}, {_label_sql('COR1M')}) AS cor1m FROM v_metric_pages"""),
], select_sql(["~ix.date", "vix", "vix3m", "pg.dspx", "pg.cor1m"], "ix LEFT JOIN pg ON ix.date = pg.date"),
    views=["v_index_quotes", "v_metric_pages"]))
def q_market_daily_pages(fx):
    """J-MERGE: market rows with the dated values of the statistics pages."""
    pages = M.page_metrics(fx.v_metric_pages).withColumn("date", F.expr("date_add(DATE '1992-01-02', cast(page_id as int))"))
    out = M.market_daily(M.market_assemble(fx.v_index_quotes), M.macro_pivot_scale(fx.v_fred_long), pages)
    return out.select("date", "vix", "vix3m", "dspx", "cor1m")


@register("market_daily_backfill", Q.build([
    ("vx", "SELECT date, close AS vix FROM v_index_quotes WHERE symbol = 'VIX'"),
    ("v3", "SELECT date, close AS vix3m FROM v_index_quotes WHERE symbol = 'VIX3M'"),
    ("ix", "SELECT coalesce(vx.date, v3.date) AS date, vix, vix3m FROM vx FULL OUTER JOIN v3 ON vx.date = v3.date"),
    ("mc", """
SELECT date, max(CASE WHEN series_id = 'BAMLH0A0HYM2' AND NOT isnan(value) THEN value END) AS hy_oas,
  max(CASE WHEN series_id = 'DGS3MO' AND NOT isnan(value) THEN value END) / 100e0 AS t_bill_3m
FROM v_fred_long GROUP BY date"""),
], select_sql(["~ix.date", "vix", "vix3m", "hy_oas", "t_bill_3m", "CAST(NULL AS DOUBLE) AS dspx",
               "CAST(NULL AS DOUBLE) AS cor1m"], "ix LEFT JOIN mc ON ix.date = mc.date"),
    views=["v_index_quotes", "v_fred_long"]))
def q_market_daily_backfill(fx):
    """J-MERGE/J-LEFT: market rows for the backfill: index dates, macro left-joined,
    page metrics absent (NULL)."""
    return M.market_daily(M.market_assemble(fx.v_index_quotes), M.macro_pivot_scale(fx.v_fred_long))


@register("upsert_last_wins", Q.build([], select_sql(
    ["~date", "~ticker", "~underlying", "strike", "~expiry", "~contract_type", "open", "close", "volume",
     "~transactions"], "v_options"), views=["v_options"]))
def q_upsert_last_wins(fx):
    """Repeated (date, ticker) loads collapse to the last load (highest seq)."""
    return TB.last_wins(fx.v_options_raw, ["date", "ticker"], [F.col("seq").desc(), F.col("open").desc()]).drop("seq")


UPD_SQL = Q.build(Q.pricing_ctes(CFG, "INNER"), select_sql(
    ["~o.date", "~o.ticker", "p.mid_price AS mid_price", "p.iv_computed AS iv_computed", "p.delta AS delta",
     "p.gamma AS gamma"], "v_options o LEFT JOIN priced p ON o.date = p.date AND o.ticker = p.ticker"),
    views=["v_options", "v_bars", "v_market"], recursive=True)


@register("update_from", UPD_SQL)
def q_update_from(fx):
    """Pricing columns set on matching contracts; contracts without a spot keep theirs."""
    cols = ["mid_price", "iv_computed", "delta", "gamma"]
    base = fx.v_options.select("date", "ticker", *[F.lit(None).cast("double").alias(c) for c in cols])
    upd = price_contracts(fx.v_options, fx.v_bars, fx.v_market, CFG, how="inner")
    return TB.update_from(base, upd, ["date", "ticker"], cols)


@register("backfill_worklist", Q.build([
    ("ct", "SELECT DISTINCT underlying AS ticker, ticker AS contract_ticker FROM v_options"),
], f"""
SELECT ticker, contract_ticker FROM ct WHERE NOT EXISTS (SELECT 1 FROM v_progress p WHERE p.ticker = ct.ticker
  AND p.contract_ticker = ct.contract_ticker AND p.last_date >= DATE '{BACKFILL_END}')""",
    views=["v_options", "v_progress"]))
def q_backfill_worklist(fx):
    """Contracts whose recorded progress does not reach the backfill end date."""
    contracts = fx.v_options.select(F.col("underlying").alias("ticker"), F.col("ticker").alias("contract_ticker"))
    return TB.backfill_worklist(contracts.distinct(), fx.v_progress, BACKFILL_END)


def _redact_sql(col):
    return (f"regexp_replace(replace({col}, '{LITERAL_KEY}', '[REDACTED]'), "
            f"'(?i)([?&]apiKey=)[^&\\s\"'']+', '\\1[REDACTED]', 'g')")


@register("redact_urls", Q.build([], f"SELECT url, {_redact_sql('url')} AS redacted_url FROM v_requests",
                                 views=["v_requests"]))
def q_redact_urls(fx):
    """secrets removed from request URLs (configured key and apiKey= values)."""
    return fx.v_requests.select("url", redact_secrets(F.col("url"), LITERAL_KEY).alias("redacted_url"))


@register("request_log_append", Q.build([], select_sql(
    ["~pulled_at", f"~{_redact_sql('url')} AS url", "~CAST(status_code AS INTEGER) AS status_code",
     "elapsed_ms"], "v_requests"), views=["v_requests"]))
def q_request_log(fx):
    """pull_log rows (redacted URL, status, elapsed ms) appended to the stored log in two runs and read back."""
    rows = TB.request_log_rows(fx.v_requests, lambda c: redact_secrets(c, LITERAL_KEY))
    root = shared_path(fx.spark, "pull-log")
    late = F.col("status_code") == 429
    TB.append_request_log(rows.where(~late), root)
    TB.append_request_log(rows.where(late), root)
    return TB.read_table(fx.spark, root, "pull_log")


def _page_sql(keys: str, order: str) -> str:
    return f"(row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1) // {VJ.PAGE} AS page"


INVENTORY_SQL = [
    ("docs", f"""
SELECT 'contracts' AS label, to_json({{'results': list({{'ticker': ticker, 'underlying_ticker': underlying, 'contract_type': contract_type,
  'exercise_style': 'american', 'primary_exchange': 'BATO', 'cfi': 'OCASPS', 'expiration_date': strftime(expiry, '%Y-%m-%d'),
  'strike_price': strike, 'shares_per_contract': 100}}), 'status': 'OK',
  'request_id': underlying || '-' || strftime(date, '%Y%m%d') || '-' || page}}) AS payload
FROM (SELECT *, {_page_sql("date, underlying", "ticker")} FROM v_options) o GROUP BY date, underlying, page
UNION ALL
SELECT 'bars', to_json({{'ticker': ticker, 'adjusted': true, 'queryCount': count(*), 'resultsCount': count(*), 'count': count(*),
  'results': list({{'v': volume, 'vw': (open + close) / 2e0, 'o': open, 'c': close, 'h': greatest(open, close), 'l': least(open, close),
    't': epoch_ms(CAST(date AS TIMESTAMP)), 'n': transactions}})}})
FROM (SELECT *, {_page_sql("ticker", "date")} FROM v_options) o GROUP BY ticker, page"""),
    ("tree", """
SELECT label, id, path, CASE WHEN whole THEN CAST(CAST(sample AS DOUBLE) AS BIGINT)::VARCHAR ELSE sample END AS sample,
  CASE WHEN whole THEN 'int' ELSE kind END AS kind FROM (
  SELECT d.label, d.id, regexp_replace(substr(t.fullkey, 3), '[[][0-9]+[]]', '[]', 'g') AS path, t.value::VARCHAR AS sample,
    CASE t.type WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' WHEN 'NULL' THEN 'NoneType' ELSE 'int' END AS kind,
    CASE WHEN t.type = 'DOUBLE' THEN TRY_CAST(t.value::VARCHAR AS DOUBLE) = floor(TRY_CAST(t.value::VARCHAR AS DOUBLE)) ELSE false END AS whole
  FROM (SELECT *, row_number() OVER () AS id FROM docs) d, json_tree(d.payload) t
  WHERE t.type NOT IN ('OBJECT', 'ARRAY') AND t.fullkey NOT LIKE '%]') x"""),
    ("inv", """
SELECT label, path, array_to_string(list_sort(list(DISTINCT kind)), '|') AS type, count(DISTINCT id) AS n_docs, min(sample) AS sample
FROM tree GROUP BY label, path"""),
]


@register("json_field_inventory", Q.build(INVENTORY_SQL, "SELECT * FROM inv", views=["v_options"]))
def q_json_field_inventory(fx):
    """Field paths, types, document counts and samples of all records of the vendor JSON corpora."""
    # Stored first, as landed files are: lines of text, read a document at a time however long they are.
    root, docs = shared_path(fx.spark, "json"), []
    for label, payloads in (("contracts", VJ.contract_payloads(fx.v_options)), ("bars", VJ.bar_payloads(fx.v_options))):
        payloads.select("payload").write.option("compression", "gzip").text(f"{root}/{label}")
        docs.append(fx.spark.read.text(f"{root}/{label}").select(F.lit(label).alias("label"), F.col("value").alias("payload")))
    return VJ.field_inventory(docs[0].unionByName(docs[1]), "payload", "label", all_elements=True)


@register("json_field_report", Q.build(INVENTORY_SQL, """
SELECT label, '**Fields returned:**' || chr(10) || chr(10) || '| Field | Type | Sample |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(
  '| `' || path || '` | ' || type || ' | ' || replace(left(sample, 80), '|', '/') || ' |', chr(10) ORDER BY path) AS report
FROM inv GROUP BY label""", views=["v_options"]))
def q_json_field_report(fx):
    """The field inventory rendered as one markdown table per corpus."""
    return VJ.field_report(q_json_field_inventory(fx))


@register("typed_options_daily", Q.build(Q.pricing_ctes(CFG), select_sql(
    ["~date", "~ticker", "~underlying", "strike", "~expiry", "~contract_type", "open",
     "CAST(NULL AS DOUBLE) AS high", "CAST(NULL AS DOUBLE) AS low", "close", "volume",
     "CAST(NULL AS DOUBLE) AS vwap", "~CAST(transactions AS INTEGER) AS transactions", "mid_price", "iv_computed",
     "delta", "gamma"], "priced"), views=["v_options", "v_bars", "v_market"], recursive=True))
def q_typed_options_daily(fx):
    """options_daily in its declared schema (keys, types, pricing columns); columns the
    source lacks are typed NULLs."""
    priced = price_contracts(fx.v_options, fx.v_bars, fx.v_market, CFG, how="left")
    return TB.conform(priced, "options_daily")
