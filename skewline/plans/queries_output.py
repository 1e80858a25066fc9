"""Queries: signal scoring and the output sinks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline import sqlcheck as Q
from skewline.config import STAGE_B_FEATURES
from skewline.operators import screen as S
from skewline.operators import stats as ST
from skewline.operators import targets as TG
from skewline.operators import walkforward as WF
from skewline.operators.features import features_daily, stock_panel
from skewline.operators.market import market_features
from skewline.plans import monitor as MO
from skewline.plans import sinks as SK
from skewline.plans.catalog import CFG, register, select_sql
from skewline.plans.queries_stats import THRESH_BY_STAMP, warning_ctes
from skewline.plans.signals import walk_forward
from skewline.session import materialize, shared_path

VIEWS = ["v_options", "v_bars", "v_market", "v_event_calendar", "v_signals"]
TOP = list(STAGE_B_FEATURES[:3])


def _gen_sql(d="f.date"):
    return f"strftime({d}, '%Y-%m-%d') || 'T22:00:00'"


def _gen(d="date"):
    return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T22:00:00"))


def score_ctes(cfg):
    sqrt_h = Q.lit(math.sqrt(cfg.horizon_days / cfg.trading_days))
    return Q.stage_a_ctes(cfg) + Q.target_ctes(cfg) + Q.walk_forward_ctes(cfg) + THRESH_BY_STAMP + [
        ("cand", "SELECT date, ticker, score_rel AS activity_score, rank FROM stage WHERE candidate"),
        ("sc0", """
SELECT c.*, s.p_magnitude, s.p_up, coalesce(s.iv_baseline_p, s.p_magnitude) AS iv_baseline_p, b.realized_vol_20d,
  coalesce(k.k, 1.5e0) AS k, coalesce(th.long_threshold, 0.55e0) AS long_threshold, coalesce(th.short_threshold, 0.45e0) AS short_threshold
FROM (SELECT c.*, r.stamp FROM cand c ASOF JOIN reg r ON c.date >= r.stamp) c JOIN v_signals s USING (date, ticker)
LEFT JOIN sp b USING (date, ticker) LEFT JOIN kcal k ON k.stamp = c.stamp AND k.ticker = c.ticker LEFT JOIN th ON th.stamp = c.stamp"""),
        ("sig", f"""
SELECT date, ticker, stamp, rank, activity_score, p_magnitude, p_up, iv_baseline_p, p_magnitude - iv_baseline_p AS marginal_lift,
  long_threshold, short_threshold,
  CASE WHEN p_magnitude < 0.55e0 THEN 'WATCH' WHEN p_up >= long_threshold THEN 'LONG'
       WHEN p_up <= short_threshold THEN 'SHORT' ELSE 'NO_DIRECTION' END AS signal,
  CASE WHEN p_magnitude < 0.55e0 THEN 'low' WHEN p_up >= long_threshold OR p_up <= short_threshold THEN
    CASE WHEN p_magnitude > 0.65e0 THEN 'high' ELSE 'medium' END ELSE 'medium' END AS confidence,
  CASE WHEN realized_vol_20d IS NOT NULL AND realized_vol_20d <> 0 THEN realized_vol_20d ELSE 0.2e0 END
    * {sqrt_h} * 100e0 * k AS threshold_pct
FROM sc0"""),
    ]


@dataclass
class Scored:
    """Walk-forward signals with what the sinks need beside them."""

    stage: DataFrame
    signals: DataFrame
    features: DataFrame
    stamps: DataFrame


def _refits(fx, stock):
    """Refits of the frozen fixture: registry, k per (stamp, ticker) and thresholds per stamp, each from the
    rows known before its stamp."""
    returns = materialize(TG.forward_returns(fx.v_bars, CFG, stock, known=True), "returns")
    rows = WF.rows_by_stamp(returns, CFG)
    scores = fx.v_signals.select("date", "ticker", "p_up", "y_direction").join(returns.select("date", "ticker", "known"), ["date", "ticker"])
    return materialize(WF.registry(rows), "refits"), WF.k_by_stamp(rows, CFG), WF.thresholds_by_stamp(WF.rows_by_stamp(scores, CFG), CFG)


def _scored(fx) -> Scored:
    # intermediates read by several branches are written once to the shared folder
    panel = S.screening_panel(fx.v_bars, CFG)
    stock = materialize(stock_panel(fx.v_bars, CFG), "stock")
    feats = materialize(features_daily(fx.v_options, fx.v_bars, fx.v_market, CFG, stock=stock), "features")
    stage = materialize(S.stage_a(panel, fx.v_bars, fx.v_options, feats, fx.v_market, CFG,
                                  events=fx.v_event_calendar), "stage")
    stamps, k, thresholds = _refits(fx, stock)
    rv = stock.select("date", "ticker", "realized_vol_20d")
    signals = walk_forward(stage.where("candidate"), fx.v_signals, rv, stamps, k, thresholds, CFG, TOP)
    return Scored(stage, materialize(signals, "signals"), feats, stamps)


SIG_OUT = ["~date", "~ticker", "~stamp", "activity_score", "p_magnitude", "p_up", "iv_baseline_p", "marginal_lift",
           "long_threshold", "short_threshold", "~signal", "~confidence", "threshold_pct"]


@register("score_signals", Q.build(score_ctes(CFG), select_sql(SIG_OUT, "sig"), views=VIEWS, recursive=True))
def q_score_signals(fx):
    """M10/F15/J-KEY/F13: LONG/SHORT/WATCH/NO_DIRECTION for every Stage A candidate (frozen probabilities)
    by k and the direction thresholds of the latest refit on or before its date."""
    return _scored(fx).signals.select(*[c.lstrip("~") for c in SIG_OUT])


REFIT_CTES = Q.stock_ctes(CFG) + Q.target_ctes(CFG) + Q.walk_forward_ctes(CFG) + THRESH_BY_STAMP


@register("refit_registry", Q.build(REFIT_CTES, "SELECT stamp, n_rows, first_date, last_known, CAST(stamp + INTERVAL "
                                    f"{CFG.refit_frequency_months} MONTH AS DATE) AS next_refit FROM reg", views=["v_bars", "v_signals"]))
def q_refit_registry(fx):
    """The refits with enough known rows, what each one learns from, and the refit after it."""
    stamps, _, _ = _refits(fx, materialize(stock_panel(fx.v_bars, CFG), "stock"))
    return stamps.withColumn("next_refit", F.add_months("stamp", CFG.refit_frequency_months))


@register("k_by_stamp", Q.build(REFIT_CTES, select_sql(["~stamp", "~ticker", "k", "~n_valid"], "kcal"), views=["v_bars", "v_signals"]))
def q_k_by_stamp(fx):
    """A5 at every refit: k per ticker from the rows known before the stamp."""
    return _refits(fx, materialize(stock_panel(fx.v_bars, CFG), "stock"))[1]


@register("thresholds_by_stamp", Q.build(REFIT_CTES, select_sql(["~stamp", "long_threshold", "short_threshold"], "th"), views=["v_bars", "v_signals"]))
def q_thresholds_by_stamp(fx):
    """A6 at every refit: direction thresholds from the scores whose outcomes are known before the stamp."""
    return _refits(fx, materialize(stock_panel(fx.v_bars, CFG), "stock"))[2]


def _r(x, d):
    return Q.r6(x, d)


def _funnel_sql():
    return ("fun", """
SELECT s.date, count(*) AS universe_size, CAST(count_if(passes) AS BIGINT) AS after_exclusions,
  CAST(count_if(candidate) AS BIGINT) AS candidates_screened,
  CAST(count_if(candidate AND g.p_magnitude >= 0.55e0) AS BIGINT) AS magnitude_passes
FROM stage s LEFT JOIN v_signals g USING (date, ticker) GROUP BY s.date""")


def _rolling_sql():
    from skewline.plans.queries_stats import auc_sql
    return [
        ("ls2", "SELECT date, 'stage_b' AS model, p_magnitude AS score, y_magnitude AS label FROM v_signals UNION ALL "
                "SELECT date, 'iv_baseline', iv_baseline_p, y_magnitude FROM v_signals"),
        ("ends", "SELECT DISTINCT date AS e FROM v_signals"),
        ("win", "SELECT d.e, l.model, l.score, l.label FROM ends d JOIN ls2 l ON l.date BETWEEN d.e - 29 AND d.e"),
        ("ra", auc_sql("win", "e, model")),
        ("lift", """
SELECT e AS date, max(CASE WHEN model = 'stage_b' THEN auc END) - max(CASE WHEN model = 'iv_baseline' THEN auc END)
  AS auc_lift FROM ra GROUP BY e"""),
    ]


SIG_STRUCT = ("{{'ticker': ticker, 'activity_score': {a}, 'p_magnitude': {pm}, 'iv_baseline_p': {ib}, "
              "'marginal_lift': {ml}, 'p_up': {pu}, 'long_threshold': {lt}, 'short_threshold': {st}, 'signal': signal, "
              "'confidence': confidence, 'threshold_pct': {tp}, 'top_features': {top}, "
              "'leakage_caveats': []::VARCHAR[]}}").format(
    a=_r("activity_score", 2), pm=_r("p_magnitude", 3), ib=_r("iv_baseline_p", 3), ml=_r("marginal_lift", 3),
    pu=_r("p_up", 3), lt=_r("long_threshold", 3), st=_r("short_threshold", 3), tp=_r("threshold_pct", 1),
    top="[" + ", ".join(f"'{t}'" for t in TOP) + "]")

def _health_ctes(ends: str) -> list[tuple[str, str]]:
    """wb, wd, warn of the 30 days up to each date of ``ends``; health_he: calibration error; health_hl: the warnings."""
    return warning_ctes(CFG, "sig", ends) + [
        ("health_he", "SELECT date, CAST(sum(abs(sp - sy)) AS DOUBLE) / sum(n) AS err FROM wb GROUP BY date"),
        ("health_hl", "SELECT date, list(warning ORDER BY warning) AS warnings FROM warn GROUP BY date"),
    ]


WATCH_SQL = Q.build(score_ctes(CFG) + [_funnel_sql()] + _rolling_sql() + _health_ctes("fun") + [
    ("sl", f"SELECT date, list({SIG_STRUCT} ORDER BY rank) AS signals FROM sig WHERE signal <> 'NO_DIRECTION' GROUP BY date"),
], f"""
SELECT f.date, CAST(len(coalesce(sl.signals, [])) AS BIGINT) AS n_signals, to_json({{
  'date': strftime(f.date, '%Y-%m-%d'), 'generated_at': {_gen_sql()},
  'market': {{'regime': CASE WHEN coalesce(nullif(m.vix, 0), 20e0) < 15 THEN 'calm'
                           WHEN coalesce(nullif(m.vix, 0), 20e0) < 25 THEN 'normal' ELSE 'elevated' END,
             'vix': coalesce(nullif(m.vix, 0), 20e0), 'vix3m': nullif(m.vix3m, 0),
             'vix_3d_change_zscore': {_r('mf.z_vix_3d_change', 3)}, 'dspx': nullif(m.dspx, 0),
             'hy_oas_5d_change_zscore': {_r('mf.z_hy_oas_5d_change', 3)}}},
  'screening': {{'universe_size': f.universe_size, 'after_exclusions': f.after_exclusions,
                'candidates_screened': f.candidates_screened, 'magnitude_passes': f.magnitude_passes}},
  'signals': coalesce(sl.signals, []),
  'health': {{'iv_baseline_auc_lift_30d': {_r('l.auc_lift', 3)}, 'stage_b_calibration_error_30d': {_r('health_he.err', 3)},
             'last_refit': strftime(f.stamp, '%Y-%m-%d'),
             'next_refit': strftime(CAST(f.stamp + INTERVAL {CFG.refit_frequency_months} MONTH AS DATE), '%Y-%m-%d'),
             'pause_warnings': coalesce(health_hl.warnings, []::VARCHAR[])}}
}}) AS payload
FROM (SELECT fun.*, reg.stamp FROM fun ASOF LEFT JOIN reg ON fun.date >= reg.stamp) f
LEFT JOIN v_market m ON f.date = m.date LEFT JOIN mf ON f.date = mf.date LEFT JOIN sl ON f.date = sl.date LEFT JOIN lift l ON f.date = l.date LEFT JOIN health_he ON f.date = health_he.date
LEFT JOIN health_hl ON f.date = health_hl.date""", views=VIEWS, recursive=True)


@register("watchlist_json", WATCH_SQL)
def q_watchlist_json(fx):
    """The nested watchlist document (market, screening funnel, signals, health) per date."""
    x = _scored(fx)
    fun = materialize(S.funnel(x.stage, fx.v_signals, CFG), "funnel")
    mf = market_features(fx.v_market, CFG)
    lift = ST.rolling_auc(fx.v_signals, {"stage_b": ("p_magnitude", "y_magnitude"),
                                         "iv_baseline": ("iv_baseline_p", "y_magnitude")}, 30)
    lift = lift.groupBy("date").agg((F.max(F.when(F.col("model") == "stage_b", F.col("auc")))
                                     - F.max(F.when(F.col("model") == "iv_baseline", F.col("auc")))).alias("auc_lift"))
    health = MO.health(fx.v_signals, MO.warnings_by_date(x.signals, fx.v_signals, x.features, fun, CFG))
    return SK.watchlist(x.signals, fun, fx.v_market, mf, lift, _gen(), health, WF.model_at(fun, x.stamps, CFG), CFG)


def _md_block_sql():
    return f"""
SELECT date, string_agg(
  printf('### %s — %s ● %s confidence', ticker, signal, confidence) || chr(10) ||
  'Move probability: ' || printf('%.0f', {_r(_r('p_magnitude', 3) + ' * 100e0', 0)}) || '% | Direction: ' ||
  CASE WHEN {_r('p_up', 3)} > 0.5e0 THEN 'up' ELSE 'down' END || ' (p_up=' || printf('%.2f', {_r(_r('p_up', 3), 2)}) || ')'
  || chr(10) || 'Stock-adjusted threshold: ±' || printf('%.1f', {_r('threshold_pct', 1)}) || '% over 5 days' || chr(10)
  || 'Key drivers: {", ".join(TOP)}' || chr(10), chr(10) ORDER BY rank) AS blocks, count(*) AS n_sig
FROM sig WHERE signal <> 'NO_DIRECTION' GROUP BY date"""


MD_SQL = Q.build(score_ctes(CFG) + [_funnel_sql(), ("blk", _md_block_sql())], f"""
SELECT f.date, '# Watchlist — ' || strftime(f.date, '%Y-%m-%d') || chr(10) || chr(10) ||
  '**Market:** ' || upper(CASE WHEN coalesce(nullif(m.vix, 0), 20e0) < 15 THEN 'calm'
                      WHEN coalesce(nullif(m.vix, 0), 20e0) < 25 THEN 'normal' ELSE 'elevated' END) ||
  ' (VIX ' || printf('%.1f', {_r('coalesce(nullif(m.vix, 0), 20e0)', 1)}) || ')' ||
  CASE WHEN m.dspx IS NOT NULL AND m.dspx <> 0 THEN ' | DSPX ' || printf('%.1f', {_r('m.dspx', 1)}) ELSE '' END || chr(10) || chr(10) ||
  printf('Screened: %d stocks → %d candidates → %d magnitude passes → %d signals', f.after_exclusions,
         f.candidates_screened, f.magnitude_passes, coalesce(b.n_sig, 0)) || chr(10) || chr(10) ||
  '---' || chr(10) || chr(10) || '## Signals' || chr(10) || chr(10) ||
  CASE WHEN coalesce(b.n_sig, 0) > 0 THEN b.blocks ELSE '*No signals today.*' END || chr(10) ||
  '---' || chr(10) || chr(10) || '## System health' || chr(10) || 'See monitoring/ for full monthly report.' AS markdown
FROM fun f LEFT JOIN v_market m ON f.date = m.date LEFT JOIN blk b ON f.date = b.date""", views=VIEWS, recursive=True)


@register("stored_watchlists", WATCH_SQL)
def q_stored_watchlists(fx):
    """The JSON documents written as one file per date and read back."""
    df = q_watchlist_json(fx)
    root = shared_path(fx.spark, "watchlists")
    df = materialize(df, "watchlists")
    SK.write_documents(df, "date", "payload", root)
    got = SK.read_documents(fx.spark, "date", root).withColumnRenamed("text", "payload")
    return df.select("date", "n_signals").join(got, "date")


@register("watchlist_markdown", MD_SQL)
def q_watchlist_markdown(fx):
    """The watchlist as a markdown document per date."""
    x = _scored(fx)
    return SK.watchlist_markdown(x.signals, S.funnel(x.stage, fx.v_signals, CFG), fx.v_market)


MONTH_SQL = Q.build(score_ctes(CFG) + [
    ("cnt", "SELECT strftime(date, '%Y-%m') AS ym, count(*) AS total_signals, CAST(last_day(max(date)) AS DATE) AS date FROM sig GROUP BY 1"),
] + _health_ctes("cnt") + [
    ("tb", f"""SELECT date, string_agg('| ' || decile || ' | ' || n || ' | ' || printf('%.3f', {_r('CAST(sp AS DOUBLE) / n', 3)}) || ' | ' ||
  printf('%.3f', {_r('CAST(sy AS DOUBLE) / n', 3)}) || ' |', chr(10) ORDER BY decile) AS t FROM wb GROUP BY date"""),
    ("th2", f"""SELECT date, string_agg('| ' || signal || ' | ' || known || ' | ' || printf('%.3f', {_r('h / known', 3)}) || ' |', chr(10)
  ORDER BY signal) AS t FROM wd WHERE known > 0 GROUP BY date"""),
], """
SELECT c.ym AS year_month, CAST(c.total_signals AS BIGINT) AS total_signals,
  CAST(len(coalesce(health_hl.warnings, [])) AS BIGINT) AS n_warnings,
  '# Monitoring Report — ' || c.ym || chr(10) || chr(10) || 'Generated: ' || c.ym || '-01T06:00:00' || chr(10) || chr(10)
  || '## Summary' || chr(10) || chr(10) || printf('- Total signals: %d', c.total_signals) || chr(10)
  || printf('- Pause warnings: %d', len(coalesce(health_hl.warnings, []))) || chr(10) || chr(10)
  || CASE WHEN len(coalesce(health_hl.warnings, [])) > 0 THEN '## Active Warnings' || chr(10)
       || array_to_string(list_transform(health_hl.warnings, lambda x: '- ⚠️ ' || x), chr(10)) || chr(10) || chr(10) ELSE '' END
  || '## Stage B Calibration' || chr(10)
  || coalesce('| Bin | Rows | Predicted | Realized |' || chr(10) || '|---|---|---|---|' || chr(10) || tb.t, 'No outcomes in the last 30 days.')
  || chr(10) || chr(10) || '## Stage C Hit Rates' || chr(10)
  || coalesce('| Signal | Rows | Hit rate |' || chr(10) || '|---|---|---|' || chr(10) || th2.t, 'No outcomes in the last 30 days.')
  || chr(10) AS report
FROM cnt c LEFT JOIN health_hl ON c.date = health_hl.date LEFT JOIN tb ON c.date = tb.date LEFT JOIN th2 ON c.date = th2.date""",
    views=VIEWS, recursive=True)


@register("monthly_report", MONTH_SQL)
def q_monthly_report(fx):
    """Per month: signal count, warnings active at month end, markdown report."""
    x = _scored(fx)
    return SK.monthly_report(x.signals, fx.v_signals, x.features, CFG,
                             generated_at=F.concat(F.col("ym"), F.lit("-01T06:00:00")))
