"""Derived test views over the driver's tables.

Each view is one SQL text that runs unchanged in Spark SQL and in DuckDB, so the
Spark side and the SQL oracle start from identical inputs.  On the Spark side the
text is analysed against temp views of the parquet files in ``sf_dir``; Catalyst
then prunes columns and pushes filters into the scans.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEW_SQL: dict[str, str] = {
    # stock_daily stand-in: one bar per (order date, ticker)
    "v_bars": """
SELECT CAST(o_orderdate AS DATE) AS date, concat('T', o_custkey % 8) AS ticker,
 min_by(p, o_orderkey) AS open, max(p) AS high, min(p) AS low, max_by(p, o_orderkey) AS close,
 count(*) * CAST(100 AS DOUBLE) AS volume
FROM (SELECT *, 100 + o_totalprice / 10000 AS p FROM orders) x GROUP BY 1, 2""",
    # options_daily before the last-wins upsert (seq = load order)
    "v_options_raw": """
SELECT CAST(l_shipdate AS DATE) AS date, concat('O:', l_orderkey, '-', l_linenumber) AS ticker,
 concat('T', l_suppkey % 8) AS underlying, CAST(110 + 5 * l_linenumber AS DOUBLE) AS strike,
 CAST(l_shipdate AS DATE) + CAST(10 + l_partkey % 60 AS INT) AS expiry,
 CASE WHEN l_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS contract_type,
 l_extendedprice / 10000 AS open, l_extendedprice / 10000 * (1 + l_discount - l_tax) AS close,
 l_quantity * 40 AS volume, CAST(l_quantity AS INT) AS transactions, l_partkey AS seq
FROM lineitem""",
    "v_options": """
SELECT date, ticker, underlying, strike, expiry, contract_type, open, close, volume, transactions
FROM (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY seq DESC, open DESC) AS rn
      FROM v_options_raw) x WHERE rn = 1""",
    "v_market": """
SELECT CAST(l_shipdate AS DATE) AS date,
 10 + (CAST(sum(l_quantity) AS BIGINT) % 200) / CAST(10 AS DOUBLE) AS vix,
 12 + (CAST(sum(l_quantity) AS BIGINT) % 170) / CAST(10 AS DOUBLE) AS vix3m,
 CASE WHEN sum(l_partkey) % 7 = 0 THEN NULL ELSE 3 + (sum(l_linenumber) % 100) / CAST(25 AS DOUBLE) END AS hy_oas,
 CASE WHEN sum(l_partkey) % 11 = 0 THEN NULL ELSE (sum(l_partkey) % 60) / CAST(1000 AS DOUBLE) END AS t_bill_3m,
 CASE WHEN sum(l_partkey) % 5 = 0 THEN NULL ELSE 10 + (sum(l_suppkey) % 150) / CAST(10 AS DOUBLE) END AS dspx,
 (sum(l_suppkey) % 90) / CAST(1 AS DOUBLE) AS cor1m
FROM lineitem GROUP BY 1""",
    # frozen probabilities and outcomes, so scoring and statistics have an oracle
    "v_signals": """
SELECT date, ticker, (k * 37 % 1000) / CAST(1000 AS DOUBLE) AS p_magnitude,
 (k * 61 % 1000) / CAST(1000 AS DOUBLE) AS p_up, (k * 29 % 1000) / CAST(1000 AS DOUBLE) AS iv_baseline_p,
 CASE WHEN (k * 53 % 1000) < (k * 37 % 1000) THEN 1 ELSE 0 END AS y_magnitude,
 CASE WHEN (k * 71 % 1000) < (k * 61 % 1000) THEN 1 ELSE 0 END AS y_direction
FROM (SELECT CAST(o_orderdate AS DATE) AS date, concat('T', o_custkey % 8) AS ticker, min(o_orderkey) AS k
      FROM orders GROUP BY 1, 2) x""",
    "v_event_calendar": """
SELECT DISTINCT concat('T', o_custkey % 8) AS ticker, CAST(o_orderdate AS DATE) AS event_date
FROM orders WHERE o_orderkey % 200 = 0""",
    "v_requests": """
SELECT ts AS pulled_at,
 concat('https://api.example.com/v2/aggs/', event_type, '?limit=5&apiKey=key', event_id) AS url,
 CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status_code, value AS elapsed_ms FROM events""",
    "v_universe_raw": """
SELECT concat(n_name, CASE WHEN n_nationkey % 5 = 0 THEN '.B' ELSE '' END) AS symbol FROM nation
UNION ALL SELECT replace(n_name, '_', '.') AS symbol FROM nation
UNION ALL SELECT '' AS symbol UNION ALL SELECT 'BAD SYM!' AS symbol""",
    "v_metric_pages": """
SELECT page_id, concat('<p>DSPX: ', page_id % 40, '.', page_id % 10, '</p><b>',
 CASE WHEN page_id % 3 = 0 THEN 'COR1M' ELSE 'implied correlation' END, '</b> ', page_id % 60, '.5 ', html) AS html
FROM pages""",
    # backfill progress: contracts whose line was returned were already pulled up to their ship date
    "v_progress": """
SELECT concat('T', l_suppkey % 8) AS ticker, concat('O:', l_orderkey, '-', l_linenumber) AS contract_ticker,
 CAST(l_shipdate AS DATE) AS last_date
FROM lineitem WHERE l_returnflag = 'R'""",
    # index closes as a long series: VIX on ship dates, VIX3M on order dates (different calendars)
    "v_index_quotes": """
SELECT CAST(l_shipdate AS DATE) AS date, 'VIX' AS symbol,
 10 + (CAST(sum(l_quantity) AS BIGINT) % 200) / CAST(10 AS DOUBLE) AS close
FROM lineitem GROUP BY 1
UNION ALL
SELECT CAST(o_orderdate AS DATE) AS date, 'VIX3M' AS symbol,
 12 + (count(*) % 170) / CAST(10 AS DOUBLE) AS close
FROM orders GROUP BY 1""",
    # macro observations as delivered: one row per (series, date), percent units, NaN for missing
    "v_fred_long": """
SELECT date, 'BAMLH0A0HYM2' AS series_id, coalesce(hy_oas, CAST('NaN' AS DOUBLE)) AS value FROM v_market
UNION ALL
SELECT date, 'DGS3MO' AS series_id, coalesce(t_bill_3m * 100, CAST('NaN' AS DOUBLE)) AS value FROM v_market""",
}

VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "v_options": ("v_options_raw",),
    "v_fred_long": ("v_market",),
}
# Read in one pass by the views over them: no stored copy is made for those.
PASSED_ON = ("v_options_raw",)


def _ordered(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in VIEW_DEPS.get(n, ()):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


# (application id, sf_dir, view) -> parquet folder holding the materialised view
_STORED: dict[tuple[str, str, str], str] = {}


class Fixtures:
    """Spark DataFrames for the base tables and derived views of one scale factor.

    The derived views stand in for the engine's stored tables (options_daily,
    stock_daily, market_daily, ...).  With ``store=True`` each view is written once per
    Spark application to a parquet table in the shared checkpoint folder and read back
    from there, so queries scan a table (column pruning, filter pushdown, one split per
    file) instead of re-deriving it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.store = store
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._cache[name]

    def view(self, name: str) -> DataFrame:
        if name in self._cache:
            return self._cache[name]
        df = self._analysed(name)
        if self.store:
            df = self._stored(name, df)
        self._cache[name] = df
        return df

    def _analysed(self, name: str) -> DataFrame:
        for dep in VIEW_DEPS.get(name, ()):
            passed = dep in PASSED_ON and dep not in self._cache
            (self._analysed(dep) if passed else self.view(dep)).createOrReplaceTempView(dep)
        for t in BASE_TABLES:
            if t in VIEW_SQL[name]:
                self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(VIEW_SQL[name])  # analysed now: later view replacement cannot change it

    def _stored(self, name: str, df: DataFrame) -> DataFrame:
        from skewline.session import shared_path, whole_groups

        key = (self.spark.sparkContext.applicationId, os.path.abspath(self.sf_dir), name)
        path = _STORED.get(key)
        if path is None:
            path = shared_path(self.spark, f"table-{name}")
            with whole_groups(self.spark):
                df.write.mode("overwrite").parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(path)

    def __getattr__(self, item: str) -> DataFrame:
        if item.startswith("v_"):
            return self.view(item)
        raise AttributeError(item)
