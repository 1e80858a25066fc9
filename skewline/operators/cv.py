"""Purged, embargoed k-fold cross-validation (W13, J-RANGE, M2, X4).

Folds are contiguous blocks of the sorted distinct dates.  The output is a long
(fold, date, role) table that any row-level frame joins on ``date``; each fold
is then a filter, so k model fits share one cached training frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings


def fold_ids(frame: DataFrame, n_splits: int = 5, date_col: str = "date") -> DataFrame:
    """Fold of each distinct date: blocks of size max(n // k, 1), the last fold takes
    the rest; with n < k each date is its own fold.

    The ordered ranking runs over distinct dates only (one row per session)."""
    dates = frame.select(F.col(date_col).alias("date")).distinct()
    w = Window.orderBy("date")
    n = dates.select(F.count(F.lit(1))).scalar()
    size = F.greatest(F.floor(n / F.lit(n_splits)), F.lit(1))
    dr = F.row_number().over(w)
    return dates.select("date", F.least(F.floor((dr - 1) / size), F.lit(n_splits - 1)).cast("int").alias("fold"))


def fold_bounds(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold").agg(F.min("date").alias("test_min"), F.max("date").alias("test_max"))


def purged_folds(folds: DataFrame, cfg: Settings = DEFAULT, horizon: int | None = None,
                 embargo: int | None = None, n_splits: int | None = None) -> DataFrame:
    """J-RANGE: role of every date in every fold: 'test', 'purged' (within the horizon of a
    test edge, or inside the embargo before/after the test block) or 'train'.

    Each date row is expanded to the k folds (k is a parameter) and joined to the k
    fold bounds on the fold id: an equi-join against a table with at most k rows."""
    h = cfg.horizon_days if horizon is None else horizon
    e = cfg.cv_embargo_days if embargo is None else embargo
    k = cfg.cv_n_folds if n_splits is None else n_splits
    bounds = F.broadcast(fold_bounds(folds).withColumnRenamed("fold", "test_fold"))  # <= k rows
    per = folds.select("date", F.col("fold").alias("own_fold"),
                       F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("test_fold"))
    df = per.join(bounds, "test_fold", "inner")
    d, lo, hi = F.col("date"), F.col("test_min"), F.col("test_max")
    purged = ((F.abs(F.datediff(d, lo)) < h) | (F.abs(F.datediff(d, hi)) < h)
              | ((d >= F.date_sub(lo, e)) & (d < lo)) | ((d > hi) & (d <= F.date_add(hi, e))))
    role = F.when(F.col("own_fold") == F.col("test_fold"), "test").when(purged, "purged").otherwise("train")
    return df.select(F.col("test_fold").alias("fold"), "date", role.alias("role"))


def split_frame(frame: DataFrame, roles: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of one fold."""
    r = roles.where(F.col("fold") == fold)
    train = frame.join(r.where(F.col("role") == "train").select("date"), "date", "left_semi")
    test = frame.join(r.where(F.col("role") == "test").select("date"), "date", "left_semi")
    return train, test
