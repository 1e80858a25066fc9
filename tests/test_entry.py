"""Driver contract, SQL statements on the smallest scale, and as-of invariance."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF001

import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "iv_atm_30dte" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    return v


@pytest.mark.parametrize("name", ["log_returns", "ewma_var", "contract_iv", "iv_by_delta", "chain_select",
                                  "exclusions", "calibrate_k", "purged_folds", "auc_exact", "decile_calibration",
                                  "page_metric_extract", "macro_pivot_scale"])
def test_sql_statement_agrees(spark, duck, name):
    sp = E.queries()[name](spark, SF001).toPandas()
    dk = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    cols = sorted(sp.columns)

    def rows(pdf):
        return sorted((tuple(_norm(None if (x != x) else x) for x in r) for r in pdf[cols].itertuples(index=False)),
                      key=repr)

    assert rows(sp) == rows(dk)


def test_features_are_point_in_time(spark):
    """Features of dates <= d do not change when every input row after d is removed."""
    from skewline.config import DEFAULT
    from skewline.operators.features import features_daily
    from skewline.sources.fixtures import Fixtures

    fx = Fixtures(spark, SF001)
    cut = fx.v_bars.select(F.percentile(F.unix_date("date"), 0.6)).collect()[0][0]
    cut_col = F.date_from_unix_date(F.lit(int(cut)))
    full = features_daily(fx.v_options, fx.v_bars, fx.v_market, DEFAULT).where(F.col("date") <= cut_col)
    part = features_daily(fx.v_options.where(F.col("date") <= cut_col), fx.v_bars.where(F.col("date") <= cut_col),
                          fx.v_market.where(F.col("date") <= cut_col), DEFAULT)
    cols = [c for c in full.columns]
    a = full.select(*cols).exceptAll(part.select(*cols)).count()
    b = part.select(*cols).exceptAll(full.select(*cols)).count()
    assert a == 0 and b == 0
