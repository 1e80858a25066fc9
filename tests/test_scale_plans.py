"""Plans and tables that keep shuffles and sorts within a task's memory as tables grow."""

import os
import tempfile
import threading

from pyspark.sql import functions as F

from skewline.operators import chain as C
from skewline.plans import models as MD
from skewline.plans import queries_streaming as QS
from skewline.sources.fixtures import Fixtures
from skewline.sources.tables import read_table


def _options(spark, n=40):
    return spark.range(n).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"), F.concat(F.lit("O:"), "id").alias("ticker"),
        F.concat(F.lit("T"), F.col("id") % 2).alias("underlying"), (F.lit(90.0) + F.col("id")).alias("strike"),
        F.lit("2024-02-10").cast("date").alias("expiry"), F.when(F.col("id") % 4 < 2, "call").otherwise("put").alias("contract_type"),
        F.lit(4.0).alias("open"), F.lit(5.0).alias("close"), F.lit(10.0).alias("volume"), F.lit(11).alias("transactions"))


def test_contracts_are_dealt_by_chain_before_pricing(spark):
    o = _options(spark)
    bars = o.select("date", F.col("underlying").alias("ticker"), F.lit(100.0).alias("close")).distinct()
    market = o.select("date", F.lit(0.03).alias("t_bill_3m")).distinct()
    got = C.price_chains(o, bars, market)
    want = C.chain_summary(C.price_contracts(o, bars, market, how="left"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan[plan.index("ArrowEvalPython"):]


def test_options_view_stores_no_copy_of_its_input(spark):
    folder = tempfile.mkdtemp(prefix="skewline-views-")
    rows = [(1, 1, 3, 2, 5.0, 100.0, 0.1, 0.02), (1, 1, 4, 2, 6.0, 90.0, 0.0, 0.02), (2, 1, 3, 9, 7.0, 80.0, 0.0, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double").withColumn("l_shipdate", F.to_timestamp_ntz(F.lit("1996-03-01 00:00:00"))).write.parquet(
        os.path.join(folder, "lineitem.parquet"))
    spark.range(1).write.parquet(os.path.join(folder, "part.parquet"))
    fx = Fixtures(spark, folder)
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    assert sorted((r.ticker, r.volume) for r in fx.v_options.collect()) == [("O:1-1", 240.0), ("O:2-1", 280.0)]
    assert [v for v in fx._cache if v.startswith("v_")] == ["v_options"]
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == before
    assert fx.v_options_raw.count() == 3


def test_rows_for_fits_fill_their_tasks(spark):
    rows = spark.range(0, 400, 1, 40).select(F.lit("2024-01-01").cast("date").alias("date"), F.col("id").cast("string").alias("ticker"))
    got = MD.packed(rows)
    assert got.rdd.getNumPartitions() == 1 and got.exceptAll(rows).count() == 0 and got.count() == 400


def test_folds_do_not_wait_for_driver_cores(spark, monkeypatch):
    monkeypatch.setattr(os, "cpu_count", lambda: 1)
    together = threading.Barrier(3, timeout=60)
    scored = spark.createDataFrame([("2024-01-01", "A", 1.0, 0.5)], "date string, ticker string, label double, p double")

    def fold(data, roles, k, *rest):
        together.wait()
        return k, None, scored.withColumn("fold", F.lit(k))

    monkeypatch.setattr(MD, "_fold_job", fold)
    assert sorted(MD.cross_validate(None, None, None, 3)[0]) == [0, 1, 2]


def test_landed_bars_are_compressed_and_come_back_whole(spark, monkeypatch):
    class Views:
        v_options = _options(spark).withColumn("transactions", F.lit(11)).localCheckpoint()

    Views.spark = spark
    roots = []
    monkeypatch.setattr(QS, "shared_path", lambda s, name: roots.append(tempfile.mkdtemp(prefix="skewline-ingest-")) or roots[-1])
    tables = QS._ingested(Views)
    assert read_table(spark, tables, "options_daily").count() == read_table(spark, tables, "backfill_progress").count() == 40
    landed = [f for _, _, files in os.walk(f"{roots[0]}/landing") for f in files if not f.startswith((".", "_"))]
    assert landed and all(f.endswith(".gz") for f in landed)
