"""Queries: AUC, drift, hit rates, calibration, thresholds and monitoring warnings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skewline import sqlcheck as Q
from skewline.operators import cv
from skewline.operators import stats as ST
from skewline.operators.features import features_daily
from skewline.config import FEATURE_NAMES
from skewline.operators.targets import linspace
from skewline.plans.catalog import CFG, register, select_sql
from skewline.session import materialize

SPECS = {"stage_b": ("p_magnitude", "y_magnitude"), "iv_baseline": ("iv_baseline_p", "y_magnitude"),
         "stage_c": ("p_up", "y_direction")}

SCORED_SQL = ("sg", f"""
SELECT *, CASE WHEN p_magnitude < 0.55e0 THEN 'WATCH' WHEN p_up >= 0.55e0 THEN 'LONG' WHEN p_up <= 0.45e0 THEN 'SHORT'
  ELSE 'NO_DIRECTION' END AS signal,
  CASE WHEN p_magnitude < 0.55e0 THEN 'low' WHEN p_up >= 0.55e0 OR p_up <= 0.45e0 THEN
    CASE WHEN p_magnitude > 0.65e0 THEN 'high' ELSE 'medium' END ELSE 'medium' END AS confidence
FROM v_signals""")
RECENT_SQL = ("rs", "SELECT * FROM sg WHERE date >= (SELECT max(date) FROM v_signals) - 30")

LONG_SQL = ("ls", " UNION ALL ".join(
    f"SELECT date, '{m}' AS model, CAST({s} AS DOUBLE) AS score, {lab} AS label FROM v_signals"
    for m, (s, lab) in SPECS.items()))


def auc_sql(src: str, group: str) -> str:
    """Rank-sum AUC with average ranks; ``group`` is a comma list (may be empty)."""
    g = f"{group}, " if group else ""
    pg = f"PARTITION BY {group}" if group else ""
    return f"""
SELECT {g}CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rsum - n_pos * (n_pos + 1) / 2e0) / (n_pos * n_neg) END AS auc,
  n_pos, n_neg FROM (
  SELECT {g}sum(CASE WHEN label = 1 THEN r + (t - 1) / 2e0 END) AS rsum, count_if(label = 1) AS n_pos,
    count_if(label = 0) AS n_neg FROM (
    SELECT *, rank() OVER ({pg} ORDER BY score) AS r, count(*) OVER ({pg}{',' if group else ''} score) AS t
    FROM {src} WHERE score IS NOT NULL AND label IS NOT NULL) a {'GROUP BY ' + group if group else ''}) b"""


def _signals(fx):
    return fx.v_signals


def _as_of(df):
    return df.select(F.max("date")).scalar()


@register("auc_exact", Q.build([LONG_SQL, ("au", auc_sql("ls", "model"))], select_sql(
    ["~model", "auc", "~CAST(n_pos AS BIGINT) AS n_pos", "~CAST(n_neg AS BIGINT) AS n_neg"], "au"),
    views=["v_signals"]))
def q_auc_exact(fx):
    """Exact ROC AUC (average ranks for ties) of the three frozen scores."""
    return ST.auc(ST.long_scores(_signals(fx), SPECS), "score", "label", ["model"])


@register("auc_by_fold", Q.build(Q.fold_ctes("v_signals", CFG.cv_n_folds) + [
    ("fs", "SELECT s.*, f.fold, p_magnitude AS score, y_magnitude AS label FROM v_signals s JOIN fo f USING (date)"),
    ("af", auc_sql("fs", "fold")),
    ("ok", "SELECT * FROM af WHERE n_pos > 0 AND n_neg > 0"),
], select_sql(["~fold", "auc", "~CAST(n_pos AS BIGINT) AS n_pos", "~CAST(n_neg AS BIGINT) AS n_neg",
               "(SELECT avg(auc) FROM ok) AS mean_auc"], "ok"), views=["v_signals"]))
def q_auc_by_fold(fx):
    """A7 per purged-CV test fold (folds with one class skipped) and their mean."""
    s = _signals(fx)
    folds = cv.fold_ids(s, CFG.cv_n_folds)
    a = ST.auc(s.join(folds, "date"), "p_magnitude", "y_magnitude", ["fold"]).where(
        (F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    return a.withColumn("mean_auc", F.avg("auc").over(Window.partitionBy()))  # <= k rows


@register("rolling_auc_lift", Q.build([
    ("ls2", "SELECT date, 'stage_b' AS model, p_magnitude AS score, y_magnitude AS label FROM v_signals UNION ALL "
            "SELECT date, 'iv_baseline', iv_baseline_p, y_magnitude FROM v_signals"),
    ("ends", "SELECT DISTINCT date AS e FROM v_signals"),
    ("win", "SELECT d.e, l.model, l.score, l.label FROM ends d JOIN ls2 l ON l.date BETWEEN d.e - 29 AND d.e"),
    ("ra", auc_sql("win", "e, model")),
], """
SELECT e AS date, {b} AS auc_model, {i} AS auc_baseline, {l} AS auc_lift, CAST(max(n_pos + n_neg) AS BIGINT) AS n
FROM ra GROUP BY e""".format(
    b=Q.r6("max(CASE WHEN model = 'stage_b' THEN auc END)"), i=Q.r6("max(CASE WHEN model = 'iv_baseline' THEN auc END)"),
    l=Q.r6("max(CASE WHEN model = 'stage_b' THEN auc END) - max(CASE WHEN model = 'iv_baseline' THEN auc END)")),
    views=["v_signals"]))
def q_rolling_auc_lift(fx):
    """Trailing 30-day AUC of the model and of the IV baseline, and the lift."""
    specs = {k: SPECS[k] for k in ("stage_b", "iv_baseline")}
    r = ST.rolling_auc(_signals(fx), specs, 30)
    g = r.groupBy("date").agg(F.max(F.when(F.col("model") == "stage_b", F.col("auc"))).alias("auc_model"),
                              F.max(F.when(F.col("model") == "iv_baseline", F.col("auc"))).alias("auc_baseline"),
                              F.max("n").alias("n"))
    return g.withColumn("auc_lift", F.col("auc_model") - F.col("auc_baseline"))


def _bootstrap(fx):
    s = ST.recent(ST.scored(_signals(fx)), _as_of(_signals(fx)))
    s = s.where(F.col("signal").isin("LONG", "SHORT"))
    hit = F.when(F.col("signal") == "LONG", F.col("y_direction") == 1).otherwise(F.col("y_direction") == 0)
    return ST.bootstrap_ci(s.withColumn("hit", hit.cast("double")), "hit", ["date", "ticker"], ["signal"], n_boot=1000,
                           ci=0.80, seed=CFG.seed)


def bootstrap_sql(n_boot: int = 1000, ci: float = 0.80) -> list[tuple[str, str]]:
    """bh: directional hits; bc: their interval, from the same md5 draws."""
    digits = ST.DRAW_DIGITS
    counts = " + ".join(f"CAST({Q.lit(t)} <= u AS INTEGER)" for t in ST.poisson_thresholds())
    return [
        ("bh", "SELECT date, ticker, signal, CASE WHEN signal = 'LONG' THEN CASE WHEN y_direction = 1 THEN 1e0 ELSE 0e0 END "
               "ELSE CASE WHEN y_direction = 0 THEN 1e0 ELSE 0e0 END END AS v FROM rs WHERE signal IN ('LONG', 'SHORT') "
               "AND y_direction IS NOT NULL"),
        ("bd", f"""
SELECT signal, b, v, {counts} AS w FROM (
  SELECT signal, b, v, CAST(CAST('0x' || substr(md5('{CFG.seed}|' || b || '|' || date || '|' || ticker), 1, {digits}) AS BIGINT)
    AS DOUBLE) / {float(16 ** digits)!r}::DOUBLE AS u
  FROM bh, (SELECT unnest(range({n_boot})) AS b) r) d"""),
        ("bp", "SELECT signal, b, sum(w * v) / sum(w) AS s FROM bd WHERE w > 0 GROUP BY signal, b"),
        ("bc", f"""
SELECT p.signal, p.n, p.point, quantile_cont(bp.s, {Q.lit((1 - ci) / 2)}) AS lo, quantile_cont(bp.s, {Q.lit(1 - (1 - ci) / 2)}) AS hi
FROM (SELECT signal, count(*) AS n, avg(v) AS point FROM bh GROUP BY signal) p JOIN bp ON p.signal = bp.signal
GROUP BY p.signal, p.n, p.point"""),
    ]


@register("bootstrap_ci", Q.build([SCORED_SQL, RECENT_SQL] + bootstrap_sql(), select_sql(
    ["~signal", "~n", "point", "lo", "hi"], "bc"), views=["v_signals"]))
def q_bootstrap_ci(fx):
    """80 % bootstrap CI (1000 Poisson replicates) of the 30-day hit rate per direction."""
    return _bootstrap(fx)


DRIFT_COLS = FEATURE_NAMES


def ks_sql(cfg, src="feat", cols=DRIFT_COLS) -> list[tuple[str, str]]:
    sides = f"""
SELECT *, CASE WHEN date >= a - 60 AND date <= a THEN 0
  WHEN date < a - 60 AND date >= CAST(a - INTERVAL 1 YEAR AS DATE) THEN 1 END AS side
FROM {src}, (SELECT max(date) AS a FROM {src} WHERE iv_atm_30dte IS NOT NULL) m"""
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, side FROM sides WHERE side IS NOT NULL "
                              f"AND {c} IS NOT NULL AND NOT isnan({c})" for c in cols)
    return [
        ("sides", sides),
        ("kl", long),
        ("kn", "SELECT feature, count_if(side = 0) AS n0, count_if(side = 1) AS n1 FROM kl GROUP BY feature"),
        ("kp", "SELECT DISTINCT feature, value FROM kl"),
        ("kc", """
SELECT p.feature, p.value, count_if(x.side = 0) AS c0, count_if(x.side = 1) AS c1
FROM kp p JOIN kl x ON x.feature = p.feature AND x.value <= p.value GROUP BY p.feature, p.value"""),
        ("ks", f"""
SELECT c.feature, max(abs(c.c0 / n.n0 - c.c1 / n.n1)) AS ks, CAST(n.n0 AS BIGINT) AS n_recent,
  CAST(n.n1 AS BIGINT) AS n_ref
FROM kc c JOIN kn n USING (feature) WHERE n.n0 > 30 AND n.n1 > 30 GROUP BY c.feature, n.n0, n.n1"""),
        ("ksd", f"""
SELECT *, CASE WHEN ks > {Q.lit(cfg.ks_drift_pause)} THEN 'pause' WHEN ks > {Q.lit(cfg.ks_drift_alert)} THEN 'alert'
  ELSE 'ok' END AS severity FROM ks"""),
    ]


def _features(fx):
    # read by the KS branches and by scalar subqueries (as-of date): store it once
    return materialize(features_daily(fx.v_options, fx.v_bars, fx.v_market, CFG), "features")


def _feature_as_of(f):
    """Latest date with a complete feature row (an ATM IV)."""
    return f.where(F.col("iv_atm_30dte").isNotNull()).select(F.max("date")).scalar()


def _ks(fx):
    f = _features(fx)
    return ST.ks_drift(f, DRIFT_COLS, _feature_as_of(f), CFG)


FEAT_VIEWS = ["v_options", "v_bars", "v_market"]


@register("ks_drift", Q.build(Q.feature_ctes(CFG) + ks_sql(CFG), select_sql(
    ["~feature", "ks", "~n_recent", "~n_ref", "~severity"], "ksd"), views=FEAT_VIEWS, recursive=True))
def q_ks_drift(fx):
    """KS statistic of recent 60 days vs the prior year for all model features, with severity."""
    return _ks(fx)


HIT_SQL = ("hr", """
SELECT signal, count(*) AS n,
  avg(CASE WHEN (signal = 'LONG' AND y_direction = 1) OR (signal = 'SHORT' AND y_direction = 0) THEN 1e0 ELSE 0e0 END)
    AS hit_rate,
  avg(CASE WHEN (signal = 'LONG' AND p_up > 0.5e0) OR (signal = 'SHORT' AND p_up < 0.5e0) THEN 1e0 ELSE 0e0 END)
    AS legacy_hit_rate
FROM rs WHERE signal IN ('LONG', 'SHORT') GROUP BY signal""")


def _recent_scored(fx):
    s = _signals(fx)
    return ST.recent(ST.scored(s), _as_of(s))


@register("hit_rate", Q.build([SCORED_SQL, RECENT_SQL, HIT_SQL], select_sql(
    ["~signal", "~n", "hit_rate", "legacy_hit_rate"], "hr"), views=["v_signals"]))
def q_hit_rate(fx):
    """A10: 30-day realized hit rate per direction (and the legacy p_up-side rate)."""
    return ST.hit_rates(_recent_scored(fx))


@register("hit_asymmetry", Q.build([SCORED_SQL, RECENT_SQL, HIT_SQL], """
SELECT {l} AS long_hit_rate, {s} AS short_hit_rate,
  max(CASE WHEN signal = 'LONG' THEN hit_rate END) > max(CASE WHEN signal = 'SHORT' THEN hit_rate END) AS long_above_short
FROM hr""".format(l=Q.r6("max(CASE WHEN signal = 'LONG' THEN hit_rate END)"),
                  s=Q.r6("max(CASE WHEN signal = 'SHORT' THEN hit_rate END)")), views=["v_signals"]))
def q_hit_asymmetry(fx):
    """LONG vs SHORT hit rate (spec: LONG should exceed SHORT)."""
    h = ST.hit_rates(_recent_scored(fx))
    lg = F.max(F.when(F.col("signal") == "LONG", F.col("hit_rate")))
    sh = F.max(F.when(F.col("signal") == "SHORT", F.col("hit_rate")))
    return h.agg(lg.alias("long_hit_rate"), sh.alias("short_hit_rate"), (lg > sh).alias("long_above_short"))


@register("marginal_lift", Q.build([SCORED_SQL, RECENT_SQL], f"""
SELECT count(*) AS n, {Q.r6('avg(p_magnitude - iv_baseline_p)')} AS marginal_lift,
  {Q.r6('avg(p_magnitude - 0.5e0)')} AS legacy_lift,
  count(*) >= 20 AND avg(p_magnitude - iv_baseline_p) < {Q.lit(CFG.marginal_auc_min)} AS below_min
FROM rs WHERE signal IN ('LONG', 'SHORT')""", views=["v_signals"]))
def q_marginal_lift(fx):
    """30-day mean lift of directional signals over the IV baseline."""
    return ST.marginal_lift(_recent_scored(fx), CFG)


def decile_sql(cfg=CFG):
    return ("dc", f"""
SELECT *, CAST(sum(CASE WHEN abs_error > {Q.lit(cfg.calibration_error_max)} THEN 1 ELSE 0 END) OVER () AS BIGINT)
  AS bins_over_max FROM (
  SELECT decile, n, mean_p, mean_y, abs(mean_p - mean_y) AS abs_error FROM (
    SELECT CAST(least(floor(p_magnitude * 10e0), 9) AS INTEGER) AS decile, count(*) AS n, avg(p_magnitude) AS mean_p,
      avg(CAST(y_magnitude AS DOUBLE)) AS mean_y
    FROM v_signals WHERE p_magnitude IS NOT NULL AND y_magnitude IS NOT NULL GROUP BY 1) a) b""")


DECILE_SQL = decile_sql()


@register("decile_calibration", Q.build([DECILE_SQL], select_sql(
    ["~decile", "~n", "mean_p", "mean_y", "abs_error", "~bins_over_max", "~bins_over_max >= 3 AS warn"], "dc"),
    views=["v_signals"]))
def q_decile_calibration(fx):
    """Predicted vs realized magnitude rate in ten probability bins."""
    return ST.decile_calibration(_signals(fx), cfg=CFG)


def _grid_values(lo, hi, num):
    return ", ".join(f"({j + 1}, {Q.lit(x)})" for j, x in enumerate(linspace(lo, hi, num)))


THRESH_SQL = [
    ("gu", f"SELECT * FROM (VALUES {_grid_values(*CFG.direction_grid)}) g(j, t)"),
    ("gd", f"SELECT * FROM (VALUES {_grid_values(CFG.direction_grid[1], CFG.direction_grid[0], CFG.direction_grid[2])}) "
           f"g(j, t)"),
    ("lu", """
SELECT g.j, g.t, count(s.p_up) AS c, sum(s.y_direction) AS h FROM gu g LEFT JOIN v_signals s ON s.p_up >= g.t
  AND s.y_direction IS NOT NULL GROUP BY g.j, g.t"""),
    ("ld", """
SELECT g.j, g.t, count(s.p_up) AS c, sum(s.y_direction) AS h FROM gd g LEFT JOIN v_signals s ON s.p_up <= g.t
  AND s.y_direction IS NOT NULL GROUP BY g.j, g.t"""),
    ("th", """
SELECT coalesce((SELECT t FROM lu WHERE c > 20 AND h / c >= 0.55e0 ORDER BY j LIMIT 1), 0.55e0) AS long_threshold,
  coalesce((SELECT t FROM ld WHERE c > 20 AND 1e0 - h / c >= 0.55e0 ORDER BY j LIMIT 1), 0.45e0) AS short_threshold"""),
]


THRESH_BY_STAMP = THRESH_SQL[:2] + [
    ("lu", "SELECT t.stamp, g.j, g.t, count(*) AS c, sum(t.y_direction) AS h FROM gu g JOIN tr t ON t.p_up >= g.t GROUP BY 1, 2, 3"),
    ("ld", "SELECT t.stamp, g.j, g.t, count(*) AS c, sum(t.y_direction) AS h FROM gd g JOIN tr t ON t.p_up <= g.t GROUP BY 1, 2, 3"),
    ("th", """
SELECT s.stamp, coalesce(l.t, 0.55e0) AS long_threshold, coalesce(d.t, 0.45e0) AS short_threshold
FROM (SELECT DISTINCT stamp FROM tr) s
LEFT JOIN (SELECT stamp, arg_min(t, j) AS t FROM lu WHERE c > 20 AND h / c >= 0.55e0 GROUP BY stamp) l USING (stamp)
LEFT JOIN (SELECT stamp, arg_min(t, j) AS t FROM ld WHERE c > 20 AND 1e0 - h / c >= 0.55e0 GROUP BY stamp) d USING (stamp)"""),
]


@register("direction_thresholds", Q.build(THRESH_SQL, select_sql(["long_threshold", "short_threshold"], "th"),
                                          views=["v_signals"]))
def q_direction_thresholds(fx):
    """First grid thresholds reaching a 55 % directional hit rate with > 20 rows."""
    return ST.direction_thresholds(_signals(fx), cfg=CFG)


@register("vix_terciles", Q.build([], select_sql(
    ["quantile_cont(vix, 0.33e0) AS q33", "quantile_cont(vix, 0.67e0) AS q67"], "v_market"), views=["v_market"]))
def q_vix_terciles(fx):
    """VIX terciles (linear interpolation)."""
    return ST.exact_percentiles(fx.v_market, "vix", [0.33, 0.67]).select(F.col("q")[0].alias("q33"), F.col("q")[1].alias("q67"))


@register("feature_medians", Q.build(Q.feature_ctes(CFG), "SELECT " + ", ".join(
    Q.rnd(f"quantile_cont({c}, 0.5e0)", c) for c in ("iv_atm_30dte", "call_put_volume_ratio")) + " FROM feat", views=["v_options", "v_bars", "v_market"],
    recursive=True))
def q_feature_medians(fx):
    """Exact medians of whole feature columns, as missing values are filled with."""
    f = _features(fx)
    return ST.exact_percentiles(f, "iv_atm_30dte", [0.5]).select(F.col("q")[0].alias("iv_atm_30dte")).crossJoin(
        ST.exact_percentiles(f, "call_put_volume_ratio", [0.5]).select(F.col("q")[0].alias("call_put_volume_ratio")))  # one row each


def ks_daily_ctes(cfg, ends: str, src="feat", cols=DRIFT_COLS) -> list[tuple[str, str]]:
    """ksd(date, feature, ks, n_recent, n_ref, severity) for every date of ``ends``."""
    long = " UNION ALL ".join(f"SELECT date, '{c}' AS feature, {c} AS value FROM {src} WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in cols)
    return [
        ("kl", long),
        ("kw", f"""
SELECT e.date, k.feature, k.value, count_if(k.date >= e.date - 60) AS a, count_if(k.date < e.date - 60) AS b
FROM (SELECT DISTINCT date FROM {ends}) e JOIN kl k ON k.date <= e.date AND k.date >= CAST(e.date - INTERVAL 1 YEAR AS DATE) GROUP BY ALL"""),
        ("kc", """
SELECT date, feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER g AS na, sum(b) OVER g AS nb FROM kw
WINDOW w AS (PARTITION BY date, feature ORDER BY value), g AS (PARTITION BY date, feature)"""),
        ("ks", """
SELECT date, feature, max(abs(ca / na - cb / nb)) AS ks, CAST(na AS BIGINT) AS n_recent, CAST(nb AS BIGINT) AS n_ref
FROM kc WHERE na > 30 AND nb > 30 GROUP BY date, feature, na, nb"""),
        ("ksd", f"""
SELECT *, CASE WHEN ks > {Q.lit(cfg.ks_drift_pause)} THEN 'pause' WHEN ks > {Q.lit(cfg.ks_drift_alert)} THEN 'alert'
  ELSE 'ok' END AS severity FROM ks"""),
    ]


def warning_ctes(cfg, sig: str, ends: str) -> list[tuple[str, str]]:
    """wb: probability bins and wd: hits of the 30 days up to each date of ``ends``; warn(date, kind, subject,
    value, warning); needs feat."""
    digits, ci, n_boot = ST.DRAW_DIGITS, 0.80, 1000
    counts = " + ".join(f"CAST({Q.lit(t)} <= u AS INTEGER)" for t in ST.poisson_thresholds())
    low = Q.lit(cfg.hit_rate_min)
    return ks_daily_ctes(cfg, ends) + [
        ("so", f"""
SELECT s.date, s.ticker, s.signal, s.p_magnitude, s.iv_baseline_p,
  CAST(CASE WHEN s.signal = 'LONG' THEN v.y_direction = 1 ELSE v.y_direction <> 1 END AS INTEGER) AS hit
FROM {sig} s LEFT JOIN v_signals v USING (date, ticker) WHERE s.signal IN ('LONG', 'SHORT')"""),
        ("wb", f"""
SELECT f.date, CAST(least(floor(s.p_magnitude * 10e0), 9) AS INTEGER) AS decile, count(*) AS n,
  sum(CAST(s.p_magnitude AS DECIMAL(18,9))) AS sp, sum(CAST(s.y_magnitude AS DECIMAL(18,9))) AS sy
FROM {ends} f JOIN v_signals s ON s.date BETWEEN f.date - 30 AND f.date
WHERE s.p_magnitude IS NOT NULL AND s.y_magnitude IS NOT NULL GROUP BY 1, 2"""),
        ("wd", f"""
SELECT f.date, s.signal, count(*) AS n, count(s.hit) AS known, coalesce(sum(s.hit), 0) AS h,
  sum(CAST(s.p_magnitude - s.iv_baseline_p AS DECIMAL(18,9))) AS l
FROM {ends} f JOIN so s ON s.date BETWEEN f.date - 30 AND f.date GROUP BY 1, 2"""),
        ("wl", f"SELECT date, signal, h / known AS rate FROM wd WHERE known >= 10 AND h / known < {low}"),
        ("bd", f"""
SELECT date, signal, b, sum(w * hit) AS sv, sum(w) AS sw FROM (
  SELECT date, signal, b, hit, {counts} AS w FROM (
    SELECT date, signal, b, hit, CAST(CAST('0x' || substr(md5('{cfg.seed}|' || b || '|' || date || '|' || ticker), 1, {digits}) AS BIGINT)
      AS DOUBLE) / {float(16 ** digits)!r}::DOUBLE AS u
    FROM so, (SELECT unnest(range({n_boot})) AS b) r WHERE hit IS NOT NULL) x) y GROUP BY 1, 2, 3"""),
        ("bt", """
SELECT f.date, f.signal, d.b, sum(d.sv) / sum(d.sw) AS s FROM wl f JOIN bd d ON d.signal = f.signal AND d.date BETWEEN f.date - 30 AND f.date
GROUP BY 1, 2, 3 HAVING sum(d.sw) > 0"""),
        ("bq", f"SELECT date, signal, quantile_cont(s, {Q.lit((1 - ci) / 2)}) AS lo FROM bt GROUP BY 1, 2"),
        ("wc", f"""
SELECT date, sum(CASE WHEN abs(CAST(sp AS DOUBLE) - CAST(sy AS DOUBLE)) / n > {Q.lit(cfg.calibration_error_max)} THEN 1 ELSE 0 END) AS b
FROM wb GROUP BY date"""),
        ("wf", "SELECT date, sum(n) AS n, CAST(sum(l) AS DOUBLE) / sum(n) AS lift FROM wd GROUP BY date"),
        ("warn", f"""
SELECT wl.date, 'hit_rate' AS kind, wl.signal AS subject, rate AS value, printf('%s hit rate below minimum', wl.signal) AS warning
FROM wl JOIN bq USING (date, signal) WHERE bq.lo < {low}
UNION ALL
SELECT date, 'drift', feature, ks, printf('Feature drift %s: %s KS=%.3f', severity, feature, {Q.r6("ks", 3)})
FROM ksd WHERE severity <> 'ok'
UNION ALL
SELECT date, 'marginal_lift', 'stage_b', lift, printf('Marginal lift below minimum (%.3f < %.2f)', {Q.r6("lift", 3)}, {Q.lit(cfg.marginal_auc_min)})
FROM wf WHERE n >= 20 AND lift < {Q.lit(cfg.marginal_auc_min)}
UNION ALL
SELECT date, 'calibration', 'stage_b', CAST(b AS DOUBLE), printf('Calibration error above %.2f in %d deciles', {Q.lit(cfg.calibration_error_max)}, CAST(b AS BIGINT))
FROM wc WHERE b >= 3"""),
    ]


@register("ks_drift_daily", Q.build(Q.feature_ctes(CFG) + ks_daily_ctes(CFG, "feat"), select_sql(
    ["~date", "~feature", "ks", "~n_recent", "~n_ref", "~severity"], "ksd"), views=FEAT_VIEWS, recursive=True))
def q_ks_drift_daily(fx):
    """A9/A20 as of every date: KS statistic of the recent 60 days vs the prior year for every feature."""
    f = _features(fx)
    return ST.ks_by_date(f, DRIFT_COLS, f.select("date"), CFG)


def _warnings(fx, cfg):
    from skewline.plans import monitor as MO
    s = _signals(fx)
    return MO.pause_warnings(ST.scored(s), s, _features(fx), _as_of(s), cfg, DRIFT_COLS)


WARN_OUT = ["~kind", "~subject", "value", "~warning"]
LAST_SIGNAL = ("wend", "SELECT max(date) AS date FROM v_signals")


@register("pause_warnings", Q.build(Q.feature_ctes(CFG) + [SCORED_SQL, LAST_SIGNAL] + warning_ctes(CFG, "sg", "wend"), select_sql(WARN_OUT, "warn"),
                                    views=FEAT_VIEWS + ["v_signals"], recursive=True))
def q_pause_warnings(fx):
    """Active warnings: hit rate, feature drift, marginal lift, calibration."""
    return _warnings(fx, CFG)


# Limits so strict that the fixture breaks every one of them.
STRICT = CFG.with_(hit_rate_min=0.95, marginal_auc_min=0.9, ks_drift_alert=0.02, ks_drift_pause=0.2,
                   calibration_error_max=0.0005)


@register("pause_warnings_strict", Q.build(Q.feature_ctes(CFG) + [SCORED_SQL, LAST_SIGNAL] + warning_ctes(STRICT, "sg", "wend"), select_sql(WARN_OUT, "warn"),
                                           views=FEAT_VIEWS + ["v_signals"], recursive=True))
def q_pause_warnings_strict(fx):
    """A21 under strict limits, where every kind of warning fires."""
    return _warnings(fx, STRICT)


QUARTER_SQL = [
    ("qs", "SELECT *, last_day(CAST(date_trunc('quarter', date) AS DATE) + INTERVAL 2 MONTH) AS stamp FROM v_signals"),
    ("qx", "SELECT stamp, p_magnitude AS score, y_magnitude AS label FROM qs"),
    ("qa", auc_sql("qx", "stamp")),
    ("qm", "SELECT CAST(stamp AS DATE) AS stamp, auc FROM qa"),
]


def _quarterly(fx):
    s = _signals(fx).withColumn("stamp", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)))
    return ST.auc(s, "p_magnitude", "y_magnitude", ["stamp"]).select("stamp", "auc")


@register("auc_vs_previous", Q.build(QUARTER_SQL, f"""
SELECT stamp, {Q.r6('auc')} AS auc, {Q.r6('lag(auc) OVER (ORDER BY stamp)')} AS prev_auc,
  {Q.r6('auc - lag(auc) OVER (ORDER BY stamp)')} AS auc_change, auc > lag(auc) OVER (ORDER BY stamp) AS improved
FROM qm""", views=["v_signals"]))
def q_auc_vs_previous(fx):
    """Each refit's AUC against the previous refit (quarterly stamps)."""
    m = _quarterly(fx)
    w = Window.orderBy("stamp")  # one row per refit
    prev = F.lag("auc").over(w)
    return m.select("stamp", "auc", prev.alias("prev_auc"), (F.col("auc") - prev).alias("auc_change"),
                    (F.col("auc") > prev).alias("improved"))


@register("refit_schedule", Q.build(QUARTER_SQL, f"""
SELECT max(stamp) AS last_refit, CAST(max(stamp) + INTERVAL {CFG.refit_frequency_months} MONTH AS DATE) AS next_refit
FROM qm""", views=["v_signals"]))
def q_refit_schedule(fx):
    """Last refit stamp and the next one (3 months later)."""
    m = _quarterly(fx)
    return m.agg(F.max("stamp").alias("last_refit")).select(
        "last_refit", F.add_months("last_refit", CFG.refit_frequency_months).alias("next_refit"))
