"""Model and drift statistics.

Order statistics (AUC, KS) never sort raw rows globally: rows are first reduced to
one row per (group, distinct value) with class counts, and only those are ordered,
inside their group.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings
from skewline.operators.targets import linspace


# --------------------------------------------------------------------------- F15 / F16


def signal_cascade(p_mag: Column, p_up: Column, long_th, short_th, cfg: Settings = DEFAULT):
    """(signal, confidence).  LONG is tested before SHORT."""
    lt = long_th if isinstance(long_th, Column) else F.lit(long_th)
    st = short_th if isinstance(short_th, Column) else F.lit(short_th)
    conf_dir = F.when(p_mag > 0.65, "high").otherwise("medium")
    sig = (F.when(p_mag < cfg.stage_b_threshold, "WATCH").when(p_up >= lt, "LONG").when(p_up <= st, "SHORT")
           .otherwise("NO_DIRECTION"))
    conf = (F.when(p_mag < cfg.stage_b_threshold, "low").when(p_up >= lt, conf_dir).when(p_up <= st, conf_dir)
            .otherwise("medium"))
    return sig, conf


def market_regime(vix: Column) -> Column:
    """F16: calm < 15 <= normal < 25 <= elevated; VIX missing or 0 -> 20 (normal)."""
    v = F.when(vix.isNull() | (vix == 0), F.lit(20.0)).otherwise(vix)
    return F.when(v < 15, "calm").when(v < 25, "normal").otherwise("elevated")


def scored(signals: DataFrame, long_th=0.55, short_th=0.45, cfg: Settings = DEFAULT) -> DataFrame:
    sig, conf = signal_cascade(F.col("p_magnitude"), F.col("p_up"), long_th, short_th, cfg)
    return signals.withColumn("signal", sig).withColumn("confidence", conf)


# --------------------------------------------------------------------------- ordered prefix sums

PREFIX_RANGES = 64


def ordered_prefix(df: DataFrame, group, value: str, cols, inclusive: bool, ranges: int = PREFIX_RANGES):
    """Adds ``cum_<c>`` = sum of ``c`` over rows of the same group with a smaller value
    (``inclusive``: smaller or equal), for rows already reduced to one per (group, value).

    Exact and parallel: one aggregate finds each group's own quantiles, which cut its values
    into about equal ranges whatever their distribution; range totals get a small prefix
    (<= ``ranges`` rows per group), and the ordered window runs per (group, range) - no task
    orders a whole group."""
    group = list(group)
    fractions = [(i + 1) / ranges for i in range(ranges - 1)]
    bounds = F.percentile_approx(value, fractions, 10 * ranges)
    if group:
        cut = df.groupBy(*group).agg(bounds.alias("_bounds"))
        same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
        d = df.join(cut.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_bounds"), same).drop(*[f"_g_{g}" for g in group])
    else:
        d = df.withColumn("_bounds", df.agg(bounds).scalar())
    d = d.withColumn("_bkt", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    tot = d.groupBy(*group, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wb = Window.partitionBy(*group).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1) if group else \
        Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)  # <= ranges rows per group
    tot = tot.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bkt").alias("_g_bkt"),
                     *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in cols])
    d = d.join(tot, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_bkt") == F.col("_g_bkt")])
    wv = Window.partitionBy(*group, "_bkt").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    out = d.select("*", *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wv), F.lit(0))).alias(f"cum_{c}")
                          for c in cols])
    return out.drop("_bkt", "_g_bkt", *[f"_g_{g}" for g in group], *[f"_o_{c}" for c in cols])


def exact_percentiles(df: DataFrame, value: str, fractions) -> DataFrame:
    """One row with ``q``, the exact percentiles (linear interpolation) of a column of any size.

    Rows become counts of distinct values, whose running sums are taken range by range (see
    ``ordered_prefix``); each of the two order statistics of a fraction is the one value whose counts
    span its rank, so no task holds or orders the column.  NULL and NaN are left out; without values
    ``q`` is NULL."""
    v = F.col(value).cast("double")
    counts = df.select(v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    placed = ordered_prefix(counts, [], "_v", ["_n"], inclusive=True).withColumn("_total", total)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("cum__n") - F.col("_n") <= rank) & (rank < F.col("cum__n")), F.col("_v")))

    parts = []
    for p in fractions:
        place = F.lit(float(p)) * (F.col("_total") - 1)
        i = len(parts) // 3
        parts += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_w{i}")]
    row = placed.agg(*parts)
    q = [F.col(f"_lo{i}") + F.col(f"_w{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i in range(len(parts) // 3)]
    return row.select(F.when(F.col("_lo0").isNotNull(), F.array(*q)).alias("q"))


# --------------------------------------------------------------------------- AUC


def auc(df: DataFrame, score: str, label: str, group=()) -> DataFrame:
    """Exact ROC AUC with average ranks for ties (Mann-Whitney), per group.

    AUC = sum over positives of (#negatives below + 0.5 #negatives tied) / (n+ n-).
    NULL when a group has a single class."""
    group = list(group)
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("_pos"), F.sum((F.col(label) == 0).cast("long")).alias("_neg"))
    counts = ordered_prefix(counts, group, score, ["_neg"], inclusive=False)
    counts = counts.withColumn("_contrib", F.col("_pos") * (F.col("cum__neg") + F.lit(0.5) * F.col("_neg")))
    out = counts.groupBy(*group).agg(F.sum("_contrib").alias("_u"), F.sum("_pos").alias("n_pos"),
                                     F.sum("_neg").alias("n_neg"))
    return out.select(*group, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                     F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
                      F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))


def long_scores(df: DataFrame, specs: dict[str, tuple[str, str]], keep=()) -> DataFrame:
    """Unpivot several (score, label) pairs into (model, score, label) rows."""
    items = [F.struct(F.lit(name).alias("model"), F.col(s).cast("double").alias("score"),
                      F.col(lab).cast("int").alias("label")) for name, (s, lab) in specs.items()]
    return df.select(*keep, F.explode(F.array(*items)).alias("_x")).select(*keep, "_x.*")


def rolling_auc(df: DataFrame, specs: dict[str, tuple[str, str]], days: int = 30) -> DataFrame:
    """AUC over the trailing ``days`` calendar days ending at each date present.

    Rows are first reduced to (date, model, score) class counts; each count row is then
    copied to the ``days`` window ends it belongs to (a fixed fan-out, not a join)."""
    ls = long_scores(df, specs, keep=("date",)).where(F.col("score").isNotNull() & F.col("label").isNotNull())
    daily = ls.groupBy("date", "model", "score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("_p"), F.sum((F.col("label") == 0).cast("long")).alias("_n"))
    ends = daily.select(F.explode(F.sequence(F.col("date"), F.date_add("date", days - 1))).alias("end"), "model",
                        "score", "_p", "_n")
    present = df.select(F.col("date").alias("end")).distinct()
    ends = ends.join(present, "end", "left_semi")
    pooled = ends.groupBy("end", "model", "score").agg(F.sum("_p").alias("_pc"), F.sum("_n").alias("_nc"))
    w = Window.partitionBy("end", "model").orderBy("score")
    below = F.coalesce(F.sum("_nc").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = pooled.withColumn("_contrib", F.col("_pc") * (below + F.lit(0.5) * F.col("_nc")))
    g = c.groupBy("end", "model").agg(F.sum("_contrib").alias("_u"), F.sum("_pc").alias("n_pos"),
                                      F.sum("_nc").alias("n_neg"))
    return g.select(F.col("end").alias("date"), "model",
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                           F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
                    (F.col("n_pos") + F.col("n_neg")).cast("bigint").alias("n"))


# --------------------------------------------------------------------------- KS


def ks_two_sample(df: DataFrame, cols, side: Column) -> DataFrame:
    """Two-sample KS statistic per column; ``side`` is 0 (recent) / 1 (reference) / NULL (unused).

    One unpivot, one (feature, value) count aggregate, one cumulative window per feature."""
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]
    long = df.select(side.alias("_side"), F.explode(F.array(*items)).alias("_x")).select("_side", "_x.*").where(
        F.col("_side").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    cnt = long.groupBy("feature", "value").agg(F.sum((F.col("_side") == 0).cast("long")).alias("_a"),
                                               F.sum((F.col("_side") == 1).cast("long")).alias("_b"))
    totals = cnt.groupBy("feature").agg(F.sum("_a").alias("n_recent"), F.sum("_b").alias("n_ref"))
    c = ordered_prefix(cnt, ["feature"], "value", ["_a", "_b"], inclusive=True).join(totals, "feature")
    na, nb = F.col("n_recent"), F.col("n_ref")
    c = c.select("feature", "n_recent", "n_ref",
                 F.abs(F.try_divide(F.col("cum__a"), na) - F.try_divide(F.col("cum__b"), nb)).alias("_d"))
    return c.groupBy("feature").agg(F.max("_d").alias("ks"), F.first("n_recent").cast("bigint").alias("n_recent"),
                                    F.first("n_ref").cast("bigint").alias("n_ref"))


def drift_severity(ks: Column, cfg: Settings = DEFAULT) -> Column:
    """Pause above 0.30, alert above 0.25."""
    return F.when(ks > cfg.ks_drift_pause, "pause").when(ks > cfg.ks_drift_alert, "alert").otherwise("ok")


def ks_drift(features: DataFrame, cols, as_of: Column, cfg: Settings = DEFAULT, recent_days: int = 60) -> DataFrame:
    """Recent 60 days vs [1 year, 60 days) before ``as_of``; both samples need > 30 values."""
    d = F.col("date")
    recent_lo = F.date_sub(as_of, recent_days)
    side = F.when((d >= recent_lo) & (d <= as_of), F.lit(0)).when((d < recent_lo) & (d >= F.add_months(as_of, -12)),
                                                                    F.lit(1))
    ks = ks_two_sample(features, cols, side)
    ok = (F.col("n_recent") > 30) & (F.col("n_ref") > 30)
    return ks.where(ok).withColumn("severity", drift_severity(F.col("ks"), cfg))


def _sliding_ks(values: pa.Table, ends: pa.Table) -> pa.Table:
    """KS of the values of [recent, day] against those of [reference, recent) for each row of ``ends``: counts
    by rank of the value are kept from one day to the next and only changed by the days that enter or leave."""
    out = {"feature": [], "day": [], "ks": [], "n_recent": [], "n_ref": []}
    if values.num_rows and ends.num_rows:
        values, ends = values.sort_by("day"), ends.sort_by("day")
        day, n = values["day"].to_numpy(), values["n"].to_numpy()
        distinct, rank = np.unique(values["value"].to_numpy(), return_inverse=True)
        counts, at = {"recent": np.zeros(len(distinct)), "ref": np.zeros(len(distinct))}, {"recent": (0, 0), "ref": (0, 0)}

        def moved(side: str, lo: int, hi: int) -> None:
            """Change a side's counts from rows [a, b) to rows [lo, hi); both borders only move forwards."""
            a, b = at[side]
            if lo >= b:
                counts[side][:] = 0
                a = b = lo
            for c, d, sign in ((a, lo, -1), (b, hi, 1)):
                if d > c:
                    counts[side][:] += sign * np.bincount(rank[c:d], n[c:d], len(distinct))
            at[side] = lo, hi

        for end, recent, reference in zip(*(ends[c].to_pylist() for c in ("day", "recent", "reference"))):
            lo, mid, hi = np.searchsorted(day, [reference, recent, end + 1])
            moved("recent", mid, hi)
            moved("ref", lo, mid)
            a, b = np.cumsum(counts["recent"]), np.cumsum(counts["ref"])
            if a[-1] and b[-1]:
                for c, v in zip(out, (values["feature"][0].as_py(), end, np.abs(a / a[-1] - b / b[-1]).max(), int(a[-1]), int(b[-1]))):
                    out[c].append(v)
    kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})


def ks_by_date(features: DataFrame, cols, dates: DataFrame, cfg: Settings = DEFAULT, recent_days: int = 60,
               block_days: int = 64) -> DataFrame:
    """A9 as of every date of ``dates``: one row per (date, feature) whose two samples hold > 30 values.

    A year of values serves the dates of a block: a value is copied to the (at most seven) blocks
    whose dates' windows it can be in, and a task slides the windows over one feature's block."""
    day = F.unix_date("date")
    block = lambda d: F.floor(d / block_days).cast("int")
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]
    long = features.select(day.alias("day"), F.explode(F.array(*items)).alias("_x")).select("day", "_x.*").where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    values = (long.groupBy("feature", "day", "value").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("block", F.explode(F.sequence(block(F.col("day")), block(F.col("day") + 366)))))
    ends = dates.select("date").distinct().select(
        day.alias("day"), F.unix_date(F.date_sub("date", recent_days)).alias("recent"), F.unix_date(F.add_months("date", -12)).alias("reference"),
        F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature")).withColumn("block", block(F.col("day")))
    ks = values.groupBy("feature", "block").cogroup(ends.groupBy("feature", "block")).applyInArrow(
        _sliding_ks, "feature string, day int, ks double, n_recent bigint, n_ref bigint")
    return ks.where((F.col("n_recent") > 30) & (F.col("n_ref") > 30)).select(
        F.date_from_unix_date("day").alias("date"), "feature", "ks", "n_recent", "n_ref", drift_severity(F.col("ks"), cfg).alias("severity"))


# --------------------------------------------------------------------------- hit rates


def recent(df: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return df.where((F.col("date") >= F.date_sub(as_of, days)) & (F.col("date") <= as_of))


def hit_rates(sig: DataFrame) -> DataFrame:
    """A10 per direction: realized hit rate (y_direction agrees) and the legacy p_up-side rate."""
    s = sig.where(F.col("signal").isin("LONG", "SHORT"))
    is_long = F.col("signal") == "LONG"
    hit = F.when(is_long, F.col("y_direction") == 1).otherwise(F.col("y_direction") == 0).cast("double")
    legacy = F.when(is_long, F.col("p_up") > 0.5).otherwise(F.col("p_up") < 0.5).cast("double")
    return s.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("hit_rate"),
                                   F.avg(legacy).alias("legacy_hit_rate"))


def marginal_lift(sig: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Mean lift of directional signals over the IV baseline (and the legacy p - 0.5)."""
    s = sig.where(F.col("signal").isin("LONG", "SHORT"))
    out = s.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p_magnitude") - F.col("iv_baseline_p")).alias(
        "marginal_lift"), F.avg(F.col("p_magnitude") - F.lit(0.5)).alias("legacy_lift"))
    return out.withColumn("below_min", (F.col("n") >= 20) & (F.col("marginal_lift") < cfg.marginal_auc_min))


# --------------------------------------------------------------------------- calibration


def decile_calibration(df: DataFrame, p: str = "p_magnitude", y: str = "y_magnitude",
                       cfg: Settings = DEFAULT) -> DataFrame:
    """Predicted vs realized rate in ten fixed probability bins [0, .1), ..., [.9, 1];
    warn when the error exceeds 0.10 in three or more bins."""
    b = F.least(F.floor(F.col(p) * F.lit(10.0)), F.lit(9)).cast("int")
    g = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(b.alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    g = g.withColumn("abs_error", F.abs(F.col("mean_p") - F.col("mean_y")))
    over = F.sum((F.col("abs_error") > cfg.calibration_error_max).cast("int")).over(Window.partitionBy())  # <= 10 rows
    return g.withColumn("bins_over_max", over.cast("bigint")).withColumn("warn", F.col("bins_over_max") >= 3)


# --------------------------------------------------------------------------- thresholds


def direction_thresholds(df: DataFrame, p: str = "p_up", y: str = "y_direction", cfg: Settings = DEFAULT, group=()) -> DataFrame:
    """A6, per group: long = first grid p (ascending 0.35..0.65, 30 points) with > 20 rows at p_up >= t
    and hit rate >= 0.55; short = first grid p (descending) with > 20 rows at p_up <= t and
    (1 - hit rate) >= 0.55; defaults 0.55 / 0.45.

    Each row computes how many grid points it clears on each side; the grid counts are
    then prefix sums of a <= 31-bin histogram."""
    group = list(group)
    lo, hi, num = cfg.direction_grid
    up, down = linspace(lo, hi, num), linspace(hi, lo, num)
    ga, gd = F.array(*[F.lit(x) for x in up]), F.array(*[F.lit(x) for x in down])
    pv, yv = F.col(p), F.col(y).cast("long")
    rows = df.where(pv.isNotNull() & F.col(y).isNotNull()).select(
        *group, F.size(F.filter(ga, lambda t: pv >= t)).alias("_ml"), F.size(F.filter(gd, lambda t: pv <= t)).alias("_ms"),
        yv.alias("_y"))

    def first_ok(mcol, grid, long_side, name):
        hist = rows.groupBy(*group, mcol).agg(F.count(F.lit(1)).alias("c"), F.sum("_y").alias("h"))
        arr = hist.groupBy(*group).agg(F.collect_list(F.struct(F.col(mcol).alias("m"), "c", "h")).alias("b"))  # <= 31 bins
        tot = lambda j, fld: F.aggregate(F.filter(F.col("b"), lambda b: b["m"] > j), F.lit(0).cast("bigint"),
                                         lambda a, b: a + b[fld])
        ok = F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda j: (tot(j, "c") > 20) & (
            (F.try_divide(tot(j, "h"), tot(j, "c")) >= cfg.direction_hit_rate_target) if long_side else
            (F.lit(1.0) - F.try_divide(tot(j, "h"), tot(j, "c")) >= cfg.direction_hit_rate_target)))
        pos = F.array_position(ok, True)
        default = 0.55 if long_side else 0.45
        return arr.select(*group, F.when(pos > 0, F.element_at(grid, pos.cast("int"))).otherwise(F.lit(default)).alias(name))

    long_t, short_t = first_ok("_ml", ga, True, "long_threshold"), first_ok("_ms", gd, False, "short_threshold")
    if group:
        return long_t.join(short_t, group)
    return long_t.select("long_threshold", short_t.select("short_threshold").scalar().alias("short_threshold"))


# --------------------------------------------------------------------------- bootstrap


def poisson_thresholds() -> list[float]:
    """P(W <= k) of a Poisson(1) count, up to where the next one rounds to 1."""
    out, term, total = [], math.exp(-1.0), 0.0
    while total + term > total:
        total += term
        out.append(total)
        term /= len(out)
    return out


# Fixed value: hex digits of the draw (52 bits).
DRAW_DIGITS = 13


def draw_counts(key: str, n_boot: int, seed: int, cdf: np.ndarray) -> np.ndarray:
    """The Poisson(1) counts of a row in all replicates."""
    u = np.array([int(hashlib.md5(f"{seed}|{b}|{key}".encode()).hexdigest()[:DRAW_DIGITS], 16) for b in range(n_boot)], float)
    return np.searchsorted(cdf, u / float(16 ** DRAW_DIGITS), side="right")


def replicate_sums(df: DataFrame, value: str, keys, group=(), n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """group, weighted and weights: for each group the replicates' sums of count x value and of
    counts, two vectors of ``n_boot``.  A task adds its rows up and sends one row per group; rows of all
    tasks are added in two steps."""
    group, keys = list(group), list(keys)
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    base = df.where(F.col(value).isNotNull()).select(*group, name.alias("_key"), F.col(value).cast("double").alias("_v"))
    types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = ", ".join([*(f"{g} {types[g]}" for g in group), "part int, weighted array<double>, weights array<double>"])
    names, cdf = [*group, "part", "weighted", "weights"], np.array(poisson_thresholds())

    def batch_of(kinds, sums: dict, part: int) -> pa.RecordBatch:
        columns = [pa.array([g[i] for g in sums], kind) for i, kind in enumerate(kinds)]
        vectors = [pa.array([s[i] for s in sums.values()], pa.list_(pa.float64())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(sums), pa.int32()), *vectors], names=names)

    def tasks(batches):
        from pyspark import TaskContext

        part, kinds = TaskContext.get().partitionId() % 32, None
        for batch in batches:
            kinds = [f.type for f in batch.schema][:len(group)]
            sums: dict = {}
            for *g, key, v in zip(*(c.to_pylist() for c in batch.columns)):
                count = draw_counts(key, n_boot, seed, cdf)
                own = sums.setdefault(tuple(g), [np.zeros(n_boot), np.zeros(n_boot)])
                own[0] += count * v
                own[1] += count
            yield batch_of(kinds, sums, part)

    def add(rows: pa.Table) -> pa.Table:
        out = {g: rows[g][:1] for g in [*group, "part"]}
        for c in ("weighted", "weights"):
            out[c] = pa.array([np.sum(rows[c].combine_chunks().flatten().to_numpy().reshape(-1, n_boot), 0)], pa.list_(pa.float64()))
        return pa.table(out)

    return (base.mapInArrow(tasks, schema).groupBy(*group, "part").applyInArrow(add, schema)
            .groupBy(*(group or [F.lit("all")])).applyInArrow(add, schema).drop("part"))


def _interval(weighted: np.ndarray, weights: np.ndarray, ci: float) -> tuple[float, float]:
    some = weights > 0
    lo, hi = np.quantile(weighted[some] / weights[some], [(1 - ci) / 2, 1 - (1 - ci) / 2])
    return float(lo), float(hi)


def trailing_ci(df: DataFrame, value: str, keys, group: str, days: int = 30, n_boot: int = 1000, ci: float = 0.80,
                seed: int = 42, block_days: int = 32) -> DataFrame:
    """A8 at every date: (end, group, lo, hi) of the mean of ``value`` over the ``days`` up to each date
    with rows there, from one draw a row: the replicate sums of the dates are added up along time."""
    daily = replicate_sums(df, value, keys, ["date", group], n_boot, seed).withColumn("day", F.unix_date("date"))
    block = lambda d: F.floor(d / block_days).cast("int")
    copies = daily.withColumn("block", F.explode(F.sequence(block(F.col("day")), block(F.col("day") + days))))

    def ends(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("day")
        day, first = rows["day"].to_numpy(), rows["block"][0].as_py() * block_days
        sums = [np.cumsum(np.concatenate([np.zeros((1, n_boot)), rows[c].combine_chunks().flatten().to_numpy().reshape(-1, n_boot)]), 0)
                for c in ("weighted", "weights")]
        out = []
        for end in range(first, first + block_days):
            a, b = np.searchsorted(day, [end - days, end + 1])
            if b > a and (sums[1][b] - sums[1][a]).any():
                out.append((end, *_interval(sums[0][b] - sums[0][a], sums[1][b] - sums[1][a], ci)))
        columns = list(zip(*out)) or [[]] * 3
        return pa.table({"day": pa.array(columns[0], pa.int32()), group: pa.array([rows[group][0].as_py()] * len(out), rows[group].type),
                         "lo": pa.array(columns[1], pa.float64()), "hi": pa.array(columns[2], pa.float64())})

    kind = df.schema[group].dataType.simpleString()
    return copies.groupBy(group, "block").applyInArrow(ends, f"day int, {group} {kind}, lo double, hi double").select(
        F.date_from_unix_date("day").alias("end"), group, "lo", "hi")


def bootstrap_ci(df: DataFrame, value: str, keys, group=(), stat=F.avg, n_boot: int = 1000, ci: float = 0.80,
                 seed: int = 42) -> DataFrame:
    """Point estimate and percentile CI of ``stat`` (any aggregate of a column) per group.

    Poisson(1) bootstrap: row and replicate draw a count from the md5 of (seed, replicate,
    the row's ``keys``), so any engine can repeat it; a row enters a replicate that many
    times, and ``stat`` is computed on every replicate.  ``keys`` must identify a row: equal
    values with different keys are drawn independently.  A mean needs two sums a replicate, which
    travel as vectors, one row per group and task; for other statistics every drawn row is copied."""
    group, keys = list(group), list(keys)
    base = df.where(F.col(value).isNotNull()).select(*group, *[k for k in keys if k not in group], F.col(value).cast("double").alias("_v"))
    if stat is F.avg:
        sums = replicate_sums(df, value, keys, group, n_boot, seed)
        schema = ", ".join([f"{g} {sums.schema[g].dataType.simpleString()}" for g in group] + ["_q array<double>"])

        def quantiles(rows: pa.Table) -> pa.Table:
            w, n = (rows[c].combine_chunks().flatten().to_numpy() for c in ("weighted", "weights"))
            q = list(_interval(w, n, ci)) if n.any() else [None, None]
            return pa.table({**{g: rows[g] for g in group}, "_q": pa.array([q], pa.list_(pa.float64()))})

        ci_df = sums.groupBy(*(group or [F.lit("all")])).applyInArrow(quantiles, schema)
    else:
        alpha = (1 - ci) / 2
        reps = base.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        name = F.concat_ws("|", F.lit(str(seed)), F.col("_b").cast("string"), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
        u = F.conv(F.substring(F.md5(name), 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** DRAW_DIGITS))
        cdf = F.array(*[F.lit(x) for x in poisson_thresholds()])
        reps = reps.withColumn("_w", F.size(F.filter(cdf, lambda t: t <= u))).where("_w > 0")
        drawn = reps.select(*group, "_b", "_v", F.explode(F.sequence(F.lit(1), F.col("_w"))).alias("_i"))
        per = drawn.groupBy(*group, "_b").agg(stat(F.col("_v")).alias("_s"))
        ci_df = per.groupBy(*group).agg(F.percentile("_s", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("_q"))
    point = base.groupBy(*group).agg(stat(F.col("_v")).alias("point"), F.count(F.lit(1)).alias("n"))
    out = point.join(ci_df, group, "inner") if group else point.select(
        "point", "n", ci_df.select(F.col("_q")).scalar().alias("_q"))
    return out.select(*group, "n", "point", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))
