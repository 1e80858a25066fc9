"""Query: the incremental bar ingest (J1) run end to end over landed files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skewline import sqlcheck as Q
from skewline.plans.catalog import CFG, register, select_sql
from skewline.session import materialize, shared_path
from skewline.sources import vendor_json as VJ
from skewline.sources.tables import read_table
from skewline.streaming.incremental_bars import start_incremental_bars

OUT = ["date", "ticker", "underlying", "strike", "expiry", "contract_type", "open", "high", "low", "close", "volume",
       "vwap", "transactions"]


@register("incremental_bars", Q.build([], select_sql(
    ["~date", "~ticker", "~underlying", "strike", "~expiry", "~contract_type", "open", "greatest(open, close) AS high",
     "least(open, close) AS low", "close", "volume", "(open + close) / 2e0 AS vwap", "~transactions"],
    "v_options", f"WHERE transactions >= {CFG.min_transactions_for_iv}"), views=["v_options"]))
def q_incremental_bars(fx):
    """Bar files land in drops with wrong, corrected and replayed bars; an availableNow
    stream with foreachBatch upserts ingests them; the result is the table."""
    spark = fx.spark
    return read_table(spark, _ingested(fx), "options_daily").select(*OUT)


@register("backfill_progress", Q.build([], select_sql(
    ["~underlying AS ticker", "~ticker AS contract_ticker", "~max(date) AS last_date"], "v_options",
    f"WHERE transactions >= {CFG.min_transactions_for_iv} GROUP BY underlying, ticker"), views=["v_options"]))
def q_backfill_progress(fx):
    """The stored progress after the ingest: the last date of every contract."""
    return read_table(fx.spark, _ingested(fx), "backfill_progress")


def _ingested(fx) -> str:
    """Run the ingest over drops of the fixture's bars; the folder of its tables."""
    spark = fx.spark
    base = shared_path(spark, "incremental")
    landing, tables, ckpt = f"{base}/landing", f"{base}/tables", f"{base}/checkpoint"
    opts = fx.v_options
    contracts = VJ.parse_contracts(VJ.contract_payloads(opts)).select(
        "as_of", "ticker", "underlying", "strike", "expiry", "contract_type")
    # Half of the contracts with one listing were listed only after their bars, as in a backfill.
    once = F.count(F.lit(1)).over(Window.partitionBy("ticker")) == 1
    contracts = contracts.withColumn("as_of", F.when(once & (F.pmod(F.xxhash64("ticker"), F.lit(2)) == 0), F.date_add("as_of", 40))
                                     .otherwise(F.col("as_of")))
    contracts = materialize(contracts, "contracts")
    part = F.pmod(F.xxhash64("ticker"), F.lit(10))
    wrong = VJ.bar_payloads(opts.where(part < 3).withColumn("close", F.col("close") * 2))
    right = lambda some: VJ.bar_payloads(opts.where(some)).select("payload")
    land = lambda lines, drop: lines.write.mode("overwrite").option("compression", "gzip").text(f"{landing}/drop={drop}")
    # In one batch: wrong bars of a part, then corrected ones, and a line that is no JSON.
    land(wrong.select("payload"), 0)
    land(right(part < 7).union(spark.createDataFrame([("{broken",)], "payload string")), 1)
    start_incremental_bars(spark, f"{landing}/*", tables, ckpt, contracts, CFG).awaitTermination()
    # The next batch: the rest and a replay of a part.
    land(right(part >= 6), 2)
    start_incremental_bars(spark, f"{landing}/*", tables, ckpt, contracts, CFG).awaitTermination()
    return tables
