"""Per-ticker time-series windows (W1-W10, J-CARRY).

Every operator here is a Catalyst window over ``partitionBy(key).orderBy(time)``;
nothing loops per ticker or per date.  A panel row is one (date, ticker), so a
partition holds at most one row per session of one ticker: its size is bounded by
the calendar, not by the data volume.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Within one anchoring block EWMA weights fall to exp(-EWMA_DECAY) at most, so they and
# their squares stay far inside the range of a double for every lambda.
EWMA_DECAY = 150.0


def wspec(part="ticker", order="date"):
    parts = [part] if isinstance(part, str) else list(part)
    orders = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*parts).orderBy(*orders)


def log_returns(df: DataFrame, price="close", part="ticker", order="date", lags=(1, 5)) -> DataFrame:
    """ln(p_t / p_{t-lag}) for each lag, as ret_1d, ret_5d, ..."""
    w = wspec(part, order)
    return df.withColumns({f"ret_{lag}d": F.log(F.try_divide(F.col(price), F.lag(price, lag).over(w)))
                           for lag in lags})


def realized_vol(ret: Column, w, window=20, annualisation=252) -> Column:
    """Sample std of the last ``window`` returns x sqrt(252); needs all of them non-null."""
    wf = w.rowsBetween(-(window - 1), 0)
    return F.when(F.count(ret).over(wf) == window, F.stddev_samp(ret).over(wf) * F.lit(math.sqrt(annualisation)))


def rolling_z(x: Column, w, window=252, min_periods=60) -> Column:
    """(x - mean) / std over the last ``window`` rows; NULL below ``min_periods`` non-null
    values or when std is 0."""
    wf = w.rowsBetween(-(window - 1), 0)
    n = F.count(x).over(wf)
    sd = F.stddev_samp(x).over(wf)
    return F.when((n >= min_periods) & (sd != 0), (x - F.avg(x).over(wf)) / sd)


def rolling_pct_rank(x: Column, w, window=252, min_periods=60) -> Column:
    """Average-rank percentile of the current value among the non-null values of the
    last ``window`` rows: (n_less + (n_equal + 1) / 2) / n."""
    wf = w.rowsBetween(-(window - 1), 0)
    vals = F.collect_list(x).over(wf)
    n = F.size(vals)
    # one pass over the window: below counts 2 per smaller value and 1 per equal value,
    # so below / 2 = n_less + n_equal / 2
    below = F.aggregate(vals, F.lit(0), lambda acc, v: acc + F.when(v < x, 2).when(v == x, 1).otherwise(0))
    return F.when(x.isNotNull() & (n >= min_periods), (below / F.lit(2.0) + F.lit(0.5)) / n)


# The sums that an EWMA variance needs, and the values seen so far.
EWM_MOMENTS = ("s0", "s1", "s2", "s3", "nobs")


def ewm_var(df: DataFrame, x: str, out: str, lam: float, part="ticker", order="date", seed: str | None = None,
            moments: str | None = None) -> DataFrame:
    """Pandas-style ``ewm(alpha=1-lam, adjust=True, ignore_na=False).var()``.

    Weights are lam**age with age counted in rows (NULL rows still age the others).
    With S0=sum w, S1=sum w x, S2=sum w x^2, S3=sum w^2:
    var = (S2/S0 - (S1/S0)^2) * S0^2 / (S0^2 - S3), defined from the second value on.

    Each S is a prefix sum anchored at the end of a block of rows, whose length follows
    from ``lam`` so that no weight leaves the range of a double, plus the totals of all
    earlier blocks, decayed block by block (one number a block and ticker).  Only rows up to
    the current one enter.  Meant for values around zero, as returns are: the variance is a
    difference of moments.  All windows are partitioned by ``part``: one shuffle.

    ``moments`` names a column for the sums after each row, and ``seed`` one with the sums before
    the first row of its part (null: none), so that a series can go on from a stored state.
    """
    if not 0 < lam < 1:
        raise ValueError("lam must lie between 0 and 1")
    B = max(1, int(EWMA_DECAY / -math.log(lam)))
    w = wspec(part, order)
    parts = [part] if isinstance(part, str) else list(part)
    keep = df.columns
    df = df.withColumns({"_rn": F.row_number().over(w), "_x": F.when(~F.isnan(x), F.col(x))})
    df = df.withColumn("_blk", F.floor((F.col("_rn") - 1) / F.lit(B)))
    age_to_anchor = (F.col("_blk") + 1) * B - F.col("_rn")  # in [0, B-1]
    m, xv = F.col("_x").isNotNull(), F.col("_x")
    qs = {"_s0": (F.when(m, F.lit(1.0)), lam), "_s1": (xv, lam), "_s2": (xv * xv, lam), "_s3": (F.when(m, F.lit(1.0)), lam * lam)}
    wb = Window.partitionBy(*parts, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({name + "p": F.sum(F.coalesce(q, F.lit(0.0)) * F.pow(F.lit(base), age_to_anchor)).over(wb)
                         for name, (q, base) in qs.items()})
    # Totals of the blocks that have ended, oldest first: a list of one entry a block.
    before = Window.partitionBy(*parts).orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.collect_list(F.when((F.col("_rn") % B) == 0, F.struct(*[name + "p" for name in qs]))).over(before)
    df = df.withColumns({"_ended": ended, "_nobs": F.count(xv).over(before.rowsBetween(Window.unboundedPreceding, 0))})
    total = {}
    for name, (_, base) in qs.items():
        older = F.aggregate("_ended", F.lit(0.0), lambda acc, t: acc * F.lit(base ** B) + t[name + "p"])  # noqa: B023
        total[name] = (F.col(name + "p") * F.pow(F.lit(base), -age_to_anchor)
                       + older * F.pow(F.lit(base), F.col("_rn") - F.col("_blk") * B))
    if seed:
        for name, (_, base) in qs.items():
            total[name] = total[name] + F.coalesce(F.col(seed)[name[1:]], F.lit(0.0)) * F.pow(F.lit(base), F.col("_rn"))
        total["_nobs"] = F.col("_nobs") + F.coalesce(F.col(seed)["nobs"], F.lit(0))
    df = df.withColumns(total)
    s0, s1, s2, s3 = (F.col(n) for n in ("_s0", "_s1", "_s2", "_s3"))
    mean = s1 / s0
    denom = s0 * s0 - s3
    var = F.when((F.col("_nobs") >= 2) & (denom > 0), (s2 / s0 - mean * mean) * (s0 * s0) / denom)
    state = [F.struct(*[F.col(f"_{n}").alias(n) for n in EWM_MOMENTS]).alias(moments)] if moments else []
    return df.select(*[c for c in keep if c != seed], var.alias(out), *state)


def nonnull_rows_z(df: DataFrame, col: str, out: str, part="ticker", order="date", window=252,
                   min_periods=20, default=0.0) -> DataFrame:
    """W10 on the non-null rows of ``col``: z of the value against the last <= ``window``
    non-null values; fewer than ``min_periods`` or a zero std gives ``default``.
    Returns (part, order, out) at the non-null rows only (callers carry it forward)."""
    parts = [part] if isinstance(part, str) else list(part)
    nn = df.select(*parts, order, col).where(F.col(col).isNotNull())
    z = with_rolling_z(nn, col, out, part, order, window, min_periods, default=default)
    return z.select(*parts, order, out)


def with_rolling_z(df: DataFrame, col: str, out: str, part="ticker", order="date", window=252,
                   min_periods=60, when: Column | None = None, default: float | None = None) -> DataFrame:
    """W5 in O(n): the same (x - mean) / std over the last ``window`` rows as
    ``rolling_z``, without a sliding frame (which Spark recomputes row by row).

    Rows fall into blocks of ``window`` rows.  A row's window is the start of its own block
    up to the row, and the end of the block before from ``window - 1`` rows back; count,
    mean and variance of both pieces come from running windows inside a block, which Spark
    updates row by row in Welford's form, and are merged by the two-sample formula.  Rows
    outside the window never enter, so a far-off value is forgotten once it has left.
    A window is constant when its least and greatest value are equal.  NaN counts as
    missing.  ``when`` optionally gates the output (NULL where false); with ``default`` a
    row with too few values or a constant window gets ``default`` instead of NULL."""
    parts = [part] if isinstance(part, str) else list(part)
    orders = [order] if isinstance(order, str) else list(order)
    w = wspec(part, order)
    keep = df.columns
    x = F.col("_x")
    df = df.withColumns({"_x": F.when(~F.isnan(col), F.col(col).cast("double")), "_rn": F.row_number().over(w)})
    df = df.withColumn("_blk", F.floor((F.col("_rn") - 1) / window))
    block = Window.partitionBy(*parts, "_blk")
    up = block.orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    down = block.orderBy(*[F.col(o).desc() for o in orders]).rowsBetween(Window.unboundedPreceding, 0)

    def piece(frame) -> Column:
        return F.struct(F.count(x).over(frame).alias("n"), F.avg(x).over(frame).alias("mean"), F.var_pop(x).over(frame).alias("var"),
                        F.min(x).over(frame).alias("lo"), F.max(x).over(frame).alias("hi"), F.col("_blk").alias("blk"))

    df = df.withColumns({"_up": piece(up), "_down": piece(down)})
    back = F.lag("_down", window - 1).over(w)
    df = df.withColumn("_old", F.when(back["blk"] < F.col("_blk"), back))
    a, b = F.col("_up"), F.col("_old")
    na, nb = a["n"], F.coalesce(b["n"], F.lit(0))
    n = na + nb
    ma, mb = F.coalesce(a["mean"], F.lit(0.0)), F.coalesce(b["mean"], F.lit(0.0))
    # From the own piece's mean: exact when only one piece has values.
    mean = F.when(na == 0, mb).otherwise(ma + (mb - ma) * nb / n)
    ss = (F.coalesce(a["var"] * na, F.lit(0.0)) + F.coalesce(b["var"] * nb, F.lit(0.0))
          + F.when((na > 0) & (nb > 0), (mb - ma) * (mb - ma) * na * nb / n).otherwise(0.0))
    constant = F.least(a["lo"], b["lo"]) == F.greatest(a["hi"], b["hi"])
    df = df.withColumns({"_n": n, "_mean": F.when(n > 0, mean), "_ss": ss, "_const": constant})
    ok = (F.col("_n") >= max(2, min_periods)) & ~F.col("_const") & x.isNotNull()
    if when is not None:
        ok = ok & when
    z = F.when(ok, F.try_divide(x - F.col("_mean"), F.sqrt(F.col("_ss") / (F.col("_n") - 1))))
    if default is not None:
        z = F.when(x.isNotNull(), F.coalesce(z, F.lit(default)))
    return df.select(*keep, z.alias(out))
