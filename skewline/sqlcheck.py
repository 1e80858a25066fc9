"""SQL re-statements of the queries, used as the DuckDB oracle.

Each builder returns plain SQL text over the driver's base tables (the derived
fixture views are inlined as CTEs).  The text is written independently of the
Spark code path where the engine allows it (ASOF JOIN for as-of look-ups,
self-joins for rolling ranks and EWMA weights, a recursive CTE for the IV
bisection); only the numeric recipe of the normal CDF and the bisection is shared,
because bit-level agreement needs the same operation order.
"""

from __future__ import annotations

from skewline.functions import bsm
from skewline.sources.fixtures import VIEW_DEPS, VIEW_SQL

ROUND = 6


def lit(x: float) -> str:
    """A DOUBLE literal (DuckDB reads plain decimals as DECIMAL)."""
    r = repr(float(x))
    return r if ("e" in r or "inf" in r or "nan" in r) else r + "e0"


def ncdf(x: str) -> str:
    ax = f"abs({x})"
    expo = f"exp(-({ax} * {ax}) / {lit(2.0)})"

    def horner(coefs):
        acc = f"{lit(coefs[0])} * {ax} + {lit(coefs[1])}"
        for c in coefs[2:]:
            acc = f"({acc}) * {ax} + {lit(c)}"
        return f"({acc})"

    near = f"{expo} * {horner(bsm.CDF_NUM)} / {horner(bsm.CDF_DEN)}"
    b = f"({ax} + {lit(0.65)})"
    for k in (4.0, 3.0, 2.0, 1.0):
        b = f"({ax} + {lit(k)} / {b})"
    far = f"{expo} / {b} / {lit(bsm.SQRT_2PI)}"
    tail = (f"(CASE WHEN {ax} > {lit(bsm.CDF_ZERO)} THEN {lit(0.0)} WHEN {ax} < {lit(bsm.CDF_SPLIT)} "
            f"THEN {near} ELSE {far} END)")
    return f"(CASE WHEN {x} > 0 THEN {lit(1.0)} - {tail} ELSE {tail} END)"


def build(ctes: list[tuple[str, str]], final: str, views=(), recursive=False) -> str:
    names: list[str] = []

    def visit(n):
        for d in VIEW_DEPS.get(n, ()):
            visit(d)
        if n not in names:
            names.append(n)

    for v in views:
        visit(v)
    parts = [f"{n} AS ({VIEW_SQL[n].strip()})" for n in names] + [f"{n} AS ({s.strip()})" for n, s in ctes]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + final) if parts else final


def r6(expr: str, digits: int = ROUND) -> str:
    """floor(x * 10^d + 0.5) / 10^d: exact IEEE steps, so both engines land on the same double."""
    scale = lit(10.0 ** digits)
    return f"(CASE WHEN abs({expr}) < 1e12 THEN floor(({expr}) * {scale} + 0.5e0) / {scale} ELSE {expr} END)"


def rnd(expr: str, alias: str, digits: int = ROUND) -> str:
    return f"{r6(expr, digits)} AS {alias}"


# --------------------------------------------------------------------------- pricing


def pricing_ctes(cfg, join="LEFT") -> list[tuple[str, str]]:
    """px: options with spot, rate, mid, T; ivr: bisection result; priced: + IV and Greeks."""
    steps = bsm.IV_STEPS
    n = ncdf
    return [
        ("spot", "SELECT date, ticker AS underlying, close AS spot FROM v_bars"),
        ("px", f"""
SELECT o.*, s.spot, coalesce(m.t_bill_3m, {lit(cfg.default_risk_free_rate)}) AS r,
       (o.open + o.close) / {lit(2.0)} AS mid_price,
       greatest(date_diff('day', o.date, o.expiry) / {lit(365.25)}, {lit(1.0 / 365.25)}) AS t_years
FROM v_options o {join} JOIN spot s ON o.date = s.date AND o.underlying = s.underlying
LEFT JOIN v_market m ON o.date = m.date
{"WHERE s.spot IS NOT NULL AND o.open IS NOT NULL AND o.close IS NOT NULL" if join == "INNER" else ""}"""),
        ("ok", """
SELECT date, ticker, spot AS s, strike AS k, t_years AS t, r, mid_price AS target, contract_type = 'call' AS is_call
FROM px WHERE spot > 0 AND mid_price > 0 AND t_years > 0 AND strike > 0
  AND CASE WHEN contract_type = 'call' THEN mid_price < spot ELSE mid_price < strike END"""),
        ("bis", f"""
SELECT date, ticker, s, k, t, r, target, is_call, 0 AS step, {lit(bsm.IV_LO)} AS lo, {lit(bsm.IV_HI)} AS hi FROM ok
UNION ALL
SELECT date, ticker, s, k, t, r, target, is_call, step + 1 AS step,
       CASE WHEN pr > target THEN lo ELSE m END AS lo, CASE WHEN pr > target THEN m ELSE hi END AS hi
FROM (SELECT *, CASE WHEN is_call THEN s * {n('d1')} - disc * {n('d2')}
                     ELSE disc * {n('-d2')} - s * {n('-d1')} END AS pr
      FROM (SELECT *, d1 - m * sq AS d2
            FROM (SELECT *, (ln(s / k) + (r + {lit(0.5)} * m * m) * t) / (m * sq) AS d1, k * exp(-r * t) AS disc
                  FROM (SELECT *, (lo + hi) / {lit(2.0)} AS m, sqrt(t) AS sq FROM bis WHERE step < {steps}) a) b) c) d"""),
        ("ivr", f"""
SELECT date, ticker, iv FROM (SELECT date, ticker, (lo + hi) / {lit(2.0)} AS iv FROM bis WHERE step = {steps}) x
WHERE iv >= {lit(cfg.iv_clamp_min)} AND iv <= {lit(cfg.iv_clamp_max)}"""),
        ("pr0", """
SELECT px.*, ivr.iv AS iv_computed,
       (ln(px.spot / px.strike) + (px.r + 0.5e0 * ivr.iv * ivr.iv) * px.t_years) / (ivr.iv * sqrt(px.t_years)) AS d1
FROM px LEFT JOIN ivr ON px.date = ivr.date AND px.ticker = ivr.ticker"""),
        ("priced", f"""
SELECT * EXCLUDE (d1),
  CASE WHEN iv_computed IS NOT NULL THEN
    CASE WHEN contract_type = 'call' THEN {n('d1')} ELSE {n('d1')} - {lit(1.0)} END END AS delta,
  CASE WHEN iv_computed IS NOT NULL THEN
    exp(-(d1 * d1) / {lit(2.0)}) / {lit(bsm.SQRT_2PI_FULL)} / (spot * iv_computed * sqrt(t_years)) END AS gamma
FROM pr0"""),
    ]


def chain_ctes() -> list[tuple[str, str]]:
    """chainf: one row per (date, underlying) of v_options with the chain features."""

    def nearest(name, where, dist):
        return (name, f"""
SELECT date, underlying, iv_computed AS {name} FROM (
  SELECT date, underlying, iv_computed, row_number() OVER (
    PARTITION BY date, underlying ORDER BY {dist}, expiry, strike, ticker) AS rn
  FROM priced WHERE {where}) x WHERE rn = 1""")

    hasd = "iv_computed IS NOT NULL AND delta IS NOT NULL"
    dte = "date_diff('day', date, expiry)"
    return [
        nearest("iv_call_50", f"{hasd} AND contract_type = 'call'", "abs(delta - 0.5e0)"),
        nearest("iv_put_50", f"{hasd} AND contract_type = 'put'", "abs(delta - -0.5e0)"),
        nearest("iv_call_25", f"{hasd} AND contract_type = 'call'", "abs(delta - 0.25e0)"),
        nearest("iv_put_25", f"{hasd} AND contract_type = 'put'", "abs(delta - -0.25e0)"),
        nearest("iv_30", "iv_computed IS NOT NULL", f"abs({dte} - 30)"),
        nearest("iv_60", "iv_computed IS NOT NULL", f"abs({dte} - 60)"),
        ("cvol", """
SELECT date, underlying,
  coalesce(sum(CASE WHEN contract_type = 'call' THEN volume END), 0e0) AS call_volume,
  coalesce(sum(CASE WHEN contract_type = 'put' THEN volume END), 0e0) AS put_volume
FROM v_options GROUP BY date, underlying"""),
        ("chainsum", """
SELECT v.*, a.iv_call_50, b.iv_put_50, c.iv_call_25, d.iv_put_25, e.iv_30, f.iv_60
FROM cvol v
LEFT JOIN iv_call_50 a USING (date, underlying) LEFT JOIN iv_put_50 b USING (date, underlying)
LEFT JOIN iv_call_25 c USING (date, underlying) LEFT JOIN iv_put_25 d USING (date, underlying)
LEFT JOIN iv_30 e USING (date, underlying) LEFT JOIN iv_60 f USING (date, underlying)"""),
        ("chainf", """
SELECT date, underlying,
  coalesce(iv_call_50, iv_30) AS iv_atm_30dte,
  CASE WHEN iv_put_25 <> 0 AND iv_call_25 <> 0 THEN iv_put_25 - iv_call_25 END AS skew_25d,
  CASE WHEN iv_60 <> 0 AND iv_30 <> 0 AND iv_30 > 0 THEN iv_60 / iv_30 END AS term_structure_60_30,
  CASE WHEN iv_call_50 <> 0 AND iv_put_50 <> 0 THEN iv_call_50 - iv_put_50 END AS cw_iv_spread,
  call_volume, put_volume,
  CASE WHEN put_volume > 0 THEN call_volume / put_volume END AS call_put_volume_ratio
FROM chainsum"""),
    ]


def zexpr(x: str, w: str, minp: int) -> str:
    return (f"CASE WHEN count({x}) OVER {w} >= {minp} AND stddev_samp({x}) OVER {w} <> 0 "
            f"THEN ({x} - avg({x}) OVER {w}) / stddev_samp({x}) OVER {w} END")


def stock_ctes(cfg) -> list[tuple[str, str]]:
    """sp: stock panel with returns, rv, ewma_var, z-scores and history depth."""
    lam = cfg.ewma_lambda
    win = cfg.rolling_window
    return [
        ("sp0", f"""
SELECT date, ticker, open, close,
  ln(close / lag(close, 1) OVER (PARTITION BY ticker ORDER BY date)) AS ret_1d,
  ln(close / lag(close, 5) OVER (PARTITION BY ticker ORDER BY date)) AS ret_5d,
  row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn
FROM v_bars"""),
        ("sp1", f"""
SELECT *, CASE WHEN count(ret_1d) OVER w = {cfg.rv_window} THEN stddev_samp(ret_1d) OVER w * sqrt({lit(cfg.trading_days)}) END
  AS realized_vol_20d
FROM sp0 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {cfg.rv_window - 1} PRECEDING AND CURRENT ROW)"""),
        ("ew", f"""
SELECT a.ticker, a.date, sum(pow({lit(lam)}, a.rn - b.rn)) AS s0, sum(pow({lit(lam)}, a.rn - b.rn) * b.ret_1d) AS s1,
  sum(pow({lit(lam)}, a.rn - b.rn) * b.ret_1d * b.ret_1d) AS s2, sum(pow({lit(lam)}, 2 * (a.rn - b.rn))) AS s3,
  count(*) AS nobs
FROM sp0 a JOIN sp0 b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 749 AND a.rn AND b.ret_1d IS NOT NULL
GROUP BY a.ticker, a.date"""),
        ("sp", f"""
SELECT s.*,
  CASE WHEN e.nobs >= 2 AND e.s0 * e.s0 - e.s3 > 0
       THEN (e.s2 / e.s0 - (e.s1 / e.s0) * (e.s1 / e.s0)) * (e.s0 * e.s0) / (e.s0 * e.s0 - e.s3) END AS ewma_var,
  {zexpr("ret_5d", "w", cfg.rolling_min_periods)} AS z_5d_return,
  {zexpr("realized_vol_20d", "w", cfg.rolling_min_periods)} AS z_realized_vol_20d,
  s.rn AS history_depth
FROM sp1 s LEFT JOIN ew e ON s.ticker = e.ticker AND s.date = e.date
WINDOW w AS (PARTITION BY s.ticker ORDER BY s.date ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW)"""),
    ]


def market_ctes(cfg) -> list[tuple[str, str]]:
    minp = cfg.rolling_min_periods
    win = cfg.rolling_window

    def obs(name, col, lag):
        return (name, f"""
SELECT date, CASE WHEN nobs > {minp} THEN {zexpr("chg", "w", minp)} END AS z FROM (
  SELECT date, {col} - lag({col}, {lag}) OVER (ORDER BY date) AS chg, row_number() OVER (ORDER BY date) AS nobs
  FROM v_market WHERE {col} IS NOT NULL) x
WINDOW w AS (ORDER BY date ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW)""")

    return [
        obs("zvix", "vix", 3),
        obs("zoas", "hy_oas", 5),
        ("mf", """
SELECT m.date, m.vix AS vix_level, m.vix3m AS vix3m_level, m.dspx AS dspx_level, m.cor1m AS cor1m_level,
  CASE WHEN m.vix IS NOT NULL AND m.vix <> 0 THEN v.z END AS z_vix_3d_change,
  o.z AS z_hy_oas_5d_change
FROM v_market m LEFT JOIN zvix v ON m.date = v.date
ASOF LEFT JOIN zoas o ON m.date >= o.date"""),
    ]


def feature_ctes(cfg) -> list[tuple[str, str]]:
    minp = cfg.rolling_min_periods
    win = cfg.rolling_window
    td = lit(cfg.trading_days)

    def prank(col):
        return (f"CASE WHEN a.{col} IS NOT NULL{' AND a.' + col + ' <> 0' if col == 'iv_atm_30dte' else ''} "
                f"AND count(b.{col}) >= {minp} THEN (count(CASE WHEN b.{col} < a.{col} THEN 1 END) + "
                f"(count(CASE WHEN b.{col} = a.{col} THEN 1 END) + {lit(1.0)}) / {lit(2.0)}) / count(b.{col}) END")

    return (pricing_ctes(cfg) + chain_ctes() + stock_ctes(cfg) + market_ctes(cfg) + [
        ("f0", f"""
SELECT c.date, c.underlying AS ticker, c.iv_atm_30dte, c.skew_25d, c.term_structure_60_30, c.cw_iv_spread,
  c.call_put_volume_ratio,
  CASE WHEN s.history_depth > 5 THEN s.z_5d_return END AS z_5d_return,
  CASE WHEN s.history_depth > {minp} THEN s.z_realized_vol_20d END AS z_realized_vol_20d,
  CASE WHEN c.iv_atm_30dte <> 0 AND s.date = c.date AND sqrt(s.ewma_var * {td}) <> 0
       THEN c.iv_atm_30dte - sqrt(s.ewma_var * {td}) END AS iv_minus_ewma_rv
FROM chainf c ASOF JOIN sp s ON c.underlying = s.ticker AND c.date >= s.date"""),
        ("f1", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS frn FROM f0"),
        ("fr", f"""
SELECT a.ticker, a.date, {prank('iv_atm_30dte')} AS iv_pct_rank_252d, {prank('skew_25d')} AS skew_pct_rank_252d
FROM f1 a JOIN f1 b ON a.ticker = b.ticker AND b.frn BETWEEN a.frn - {win - 1} AND a.frn
GROUP BY a.ticker, a.date, a.iv_atm_30dte, a.skew_25d"""),
        ("feat", f"""
SELECT f.date, f.ticker, f.iv_atm_30dte, r.iv_pct_rank_252d, f.iv_minus_ewma_rv,
  CASE WHEN f.iv_minus_ewma_rv IS NOT NULL THEN {zexpr('f.iv_minus_ewma_rv', 'w', minp)} END AS z_iv_minus_ewma_rv,
  r.skew_pct_rank_252d, f.term_structure_60_30,
  CASE WHEN f.call_put_volume_ratio <> 0 THEN {zexpr('f.call_put_volume_ratio', 'w', minp)} END
    AS z_call_put_volume_ratio,
  f.z_5d_return, m.vix_level, m.z_vix_3d_change, m.vix3m_level, m.z_hy_oas_5d_change, m.dspx_level, m.cor1m_level,
  f.z_realized_vol_20d, f.cw_iv_spread, f.call_put_volume_ratio, f.skew_25d
FROM f1 f JOIN fr r ON f.ticker = r.ticker AND f.date = r.date
LEFT JOIN mf m ON f.date = m.date
WINDOW w AS (PARTITION BY f.ticker ORDER BY f.date ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW)"""),
    ])


# --------------------------------------------------------------------------- screen


def screen_ctes(cfg, events=True) -> list[tuple[str, str]]:
    """panel, hd, ov, tf, excl: exclusions with the first failing reason."""
    bench = cfg.benchmark_ticker
    ev = (f"EXISTS (SELECT 1 FROM v_event_calendar e WHERE e.ticker = p.ticker "
          f"AND abs(date_diff('day', e.event_date, p.date)) <= {cfg.earnings_buffer_days})") if events else "false"
    return [
        ("panel", f"SELECT date, ticker FROM v_bars WHERE ticker <> '{bench}'"),
        ("hd", "SELECT date, ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS history_depth FROM v_bars"),
        ("od", "SELECT underlying AS ticker, date, sum(volume) AS vs, count(volume) AS vn FROM v_options GROUP BY 1, 2"),
        ("ov", """
SELECT p.date, p.ticker, CASE WHEN sum(o.vn) > 0 THEN sum(o.vs) / sum(o.vn) END AS avg_option_volume_20d
FROM panel p LEFT JOIN od o ON o.ticker = p.ticker AND o.date <= p.date AND o.date > p.date - 20
GROUP BY p.date, p.ticker"""),
        ("tf", """
SELECT date, ticker, first_day + CAST((5 - dayofweek(first_day) + 7) % 7 AS INTEGER) + 14 AS third_friday
FROM (SELECT date, ticker, CAST(date_trunc('month', date) AS DATE) AS first_day FROM panel) x"""),
        ("excl", f"""
SELECT p.date, p.ticker, CASE
  WHEN {ev} THEN 'earnings_window'
  WHEN abs(date_diff('day', t.third_friday, p.date)) <= {cfg.opex_buffer_days} THEN 'opex_window'
  WHEN coalesce(h.history_depth, 0) < {cfg.min_history_days} THEN 'insufficient_history'
  WHEN v.avg_option_volume_20d IS NULL OR v.avg_option_volume_20d < {lit(cfg.min_option_volume_20d)}
    THEN 'insufficient_option_volume' END AS reason
FROM panel p JOIN tf t USING (date, ticker) LEFT JOIN hd h USING (date, ticker) LEFT JOIN ov v USING (date, ticker)"""),
    ]


def activity_ctes(cfg) -> list[tuple[str, str]]:
    """act: activity score at every panel row and at every panel date for the benchmark; rel: relative score."""
    minp = cfg.screen_z_min_periods
    win = cfg.rolling_window
    cols = ("call_put_volume_ratio", "iv_pct_rank_252d", cfg.activity_rv_column)
    out = []
    for i, c in enumerate(cols):
        out.append((f"w10_{i}", f"""
SELECT ticker, date, CASE WHEN count({c}) OVER w >= {minp} AND stddev_samp({c}) OVER w <> 0
  THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w ELSE 0e0 END AS z
FROM feat WHERE {c} IS NOT NULL
WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW)"""))
    out += [
        ("targets", f"SELECT date, ticker FROM panel UNION SELECT DISTINCT date, '{cfg.benchmark_ticker}' FROM panel"),
        ("act", """
SELECT t.date, t.ticker, coalesce(a.z, 0e0) AS z_cp, coalesce(b.z, 0e0) AS z_iv_rank, coalesce(c.z, 0e0) AS z_iv_rv,
  0.5e0 * coalesce(a.z, 0e0) + 0.3e0 * coalesce(b.z, 0e0) + 0.2e0 * coalesce(c.z, 0e0) AS activity_score
FROM targets t
ASOF LEFT JOIN w10_0 a ON t.ticker = a.ticker AND t.date >= a.date
ASOF LEFT JOIN w10_1 b ON t.ticker = b.ticker AND t.date >= b.date
ASOF LEFT JOIN w10_2 c ON t.ticker = c.ticker AND t.date >= c.date"""),
        ("rel", f"""
SELECT a.date, a.ticker, a.activity_score, a.activity_score - coalesce(b.activity_score, 0e0) AS score_rel
FROM act a LEFT JOIN (SELECT date, activity_score FROM act WHERE ticker = '{cfg.benchmark_ticker}') b USING (date)
WHERE a.ticker <> '{cfg.benchmark_ticker}'"""),
    ]
    return out


def stage_a_ctes(cfg) -> list[tuple[str, str]]:
    n_expr = (f"CAST(least(floor({lit(cfg.stage_a_base)} + {lit(cfg.stage_a_slope)} * "
              f"least(greatest(coalesce(nullif(m.vix, 0), 20e0) / 20e0, 0.5e0), 2e0)), {cfg.stage_a_max}) AS INTEGER)")
    return feature_ctes(cfg) + screen_ctes(cfg) + activity_ctes(cfg) + [
        ("sa0", f"""
SELECT e.date, e.ticker, e.reason, e.reason IS NULL AS passes, r.activity_score, r.score_rel, {n_expr} AS n_select
FROM excl e LEFT JOIN rel r USING (date, ticker) LEFT JOIN v_market m ON e.date = m.date"""),
        ("sa", """
SELECT *, CASE WHEN passes THEN row_number() OVER (PARTITION BY date ORDER BY passes DESC, score_rel DESC, ticker) END
  AS rank FROM sa0"""),
        ("stage", "SELECT *, coalesce(rank <= n_select, false) AS candidate FROM sa"),
    ]


# --------------------------------------------------------------------------- targets and CV


def target_ctes(cfg) -> list[tuple[str, str]]:
    """ft: forward returns over stock sessions (needs sp)."""
    import math
    h = cfg.horizon_days
    return [
        ("ft0", f"""
SELECT date, ticker, close, realized_vol_20d, lead({cfg.entry_price}, 1) OVER w AS entry,
  lead(close, {h}) OVER w AS exit_px, row_number() OVER w AS rn, count(*) OVER (PARTITION BY ticker) AS n
FROM sp WINDOW w AS (PARTITION BY ticker ORDER BY date)"""),
        ("ft", f"""
SELECT date, ticker, close, realized_vol_20d, ln(exit_px / entry) AS fwd_ret,
  CASE WHEN realized_vol_20d > 0 THEN realized_vol_20d * {lit(math.sqrt(h / cfg.trading_days))}
       ELSE {lit(cfg.default_sigma_window)} END AS sigma
FROM ft0 WHERE rn <= n - {h + 1} AND entry IS NOT NULL AND exit_px IS NOT NULL AND entry > 0"""),
    ]


def kcal_ctes(cfg, src: str, prefix: str = "k", key: str = "ticker") -> list[tuple[str, str]]:
    """{prefix}cal(key, k, n_valid) by brute force over the grid; ``key`` is a comma list."""
    import numpy as np
    lo, hi, num = cfg.k_grid
    vals = ", ".join(f"({j + 1}, {lit(float(x))})" for j, x in enumerate(np.linspace(lo, hi, num)))
    p = prefix
    return [
        (f"{p}grid", f"SELECT * FROM (VALUES {vals}) g(j, k)"),
        (f"{p}base", f"""
SELECT {key}, count(*) AS n_rows, count(*) FILTER (WHERE sigma > 0 AND isfinite(fwd_ret)) AS n_valid
FROM {src} GROUP BY {key}"""),
        (f"{p}rate", f"""
SELECT {key}, j, CAST(sum(CASE WHEN abs(fwd_ret) > grid_k * sigma THEN 1 ELSE 0 END) AS BIGINT) AS hits
FROM {src} CROSS JOIN (SELECT j, k AS grid_k FROM {p}grid) g WHERE sigma > 0 AND isfinite(fwd_ret) GROUP BY ALL"""),
        (f"{p}first", f"""
SELECT {key}, min(j) AS j FROM {p}rate JOIN {p}base USING ({key})
WHERE abs(hits / n_valid - {lit(cfg.base_rate_target)}) < 0.05e0 GROUP BY {key}"""),
        (f"{p}cal", f"""
SELECT {key}, CASE WHEN n_rows >= 50 AND n_valid >= 50 AND f.j IS NOT NULL THEN g.k
  ELSE {lit(cfg.default_k_threshold)} END AS k, n_valid
FROM {p}base LEFT JOIN {p}first f USING ({key}) LEFT JOIN {p}grid g ON g.j = f.j"""),
    ]


def label_cte(name: str, src: str, kname: str, cfg) -> tuple[str, str]:
    return (name, f"""
SELECT s.*, coalesce(c.k, {lit(cfg.default_k_threshold)}) AS k,
  coalesce(c.k, {lit(cfg.default_k_threshold)}) * s.sigma AS threshold,
  CAST(abs(s.fwd_ret) > coalesce(c.k, {lit(cfg.default_k_threshold)}) * s.sigma AS INTEGER) AS y_magnitude,
  CAST(s.fwd_ret > 0 AS INTEGER) AS y_direction
FROM {src} s LEFT JOIN {kname} c USING (ticker)""")


def fold_ctes(src: str, n_splits: int) -> list[tuple[str, str]]:
    return [
        ("fd", f"SELECT DISTINCT date FROM {src}"),
        ("fo", f"""
SELECT date, CAST(least(floor((row_number() OVER (ORDER BY date) - 1)
  / greatest(floor((SELECT count(*) FROM fd) / {n_splits}), 1)), {n_splits - 1}) AS INTEGER) AS fold FROM fd"""),
        ("fb", "SELECT fold, min(date) AS test_min, max(date) AS test_max FROM fo GROUP BY fold"),
    ]


def roles_cte(cfg) -> tuple[str, str]:
    h, e = cfg.horizon_days, cfg.cv_embargo_days
    return ("roles", f"""
SELECT fb.fold, fo.date, CASE WHEN fo.fold = fb.fold THEN 'test'
  WHEN abs(date_diff('day', fb.test_min, fo.date)) < {h} OR abs(date_diff('day', fb.test_max, fo.date)) < {h}
    OR (fo.date >= fb.test_min - {e} AND fo.date < fb.test_min) OR (fo.date > fb.test_max AND fo.date <= fb.test_max + {e})
  THEN 'purged' ELSE 'train' END AS role
FROM fo CROSS JOIN fb""")


def training_ctes(cfg) -> list[tuple[str, str]]:
    days = 365 * cfg.training_window_years + 30
    return feature_ctes(cfg) + target_ctes(cfg) + [
        ("tf0", f"""
SELECT f.*, t.close AS stock_close, t.realized_vol_20d, t.fwd_ret, t.sigma
FROM feat f JOIN ft t USING (date, ticker) WHERE f.date >= (SELECT max(date) FROM feat) - {days}"""),
    ] + kcal_ctes(cfg, "tf0", "t") + [label_cte("tframe", "tf0", "tcal", cfg)]


def walk_forward_ctes(cfg) -> list[tuple[str, str]]:
    """stamps, kr (training rows by stamp), reg (refits), kcal(stamp, ticker, k), tr (scores by stamp); needs sp and ft."""
    m = cfg.refit_frequency_months
    days = 365 * cfg.training_window_years + 30
    serves = f"f.known < s.stamp AND f.date >= s.stamp - {days}"
    return [
        ("fk", f"""
SELECT f.*, k.known FROM ft f JOIN (SELECT date, ticker, lead(date, {cfg.horizon_days + 1}) OVER (PARTITION BY ticker ORDER BY date) AS known
  FROM sp) k USING (date, ticker)"""),
        ("stamps", f"""
SELECT CAST(unnest(generate_series(date_trunc('year', (SELECT min(date) FROM sp)), (SELECT max(known) FROM fk) + INTERVAL {m} MONTH,
  INTERVAL {m} MONTH)) AS DATE) AS stamp"""),
        ("kr", f"SELECT s.stamp, f.* FROM stamps s JOIN fk f ON {serves}"),
        ("reg", """
SELECT stamp, count(*) AS n_rows, min(date) AS first_date, max(known) AS last_known FROM kr GROUP BY stamp HAVING count(*) >= 200"""),
    ] + kcal_ctes(cfg, "kr", key="stamp, ticker") + [
        ("tr", f"""
SELECT s.stamp, f.p_up, f.y_direction FROM stamps s JOIN (SELECT v.*, fk.known FROM v_signals v JOIN fk USING (date, ticker)) f ON {serves}
WHERE f.y_direction IS NOT NULL AND f.p_up IS NOT NULL"""),
    ]
