"""Queries: chain scope, calendar look-ups and Stage A screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from skewline import sqlcheck as Q
from skewline.operators import chain as C
from skewline.operators import screen as S
from skewline.operators.calendar import session_asof
from skewline.operators.features import features_daily
from skewline.plans.catalog import CFG, register, select_sql
from skewline.session import materialize

VIEWS = ["v_options", "v_bars", "v_market"]
SCREEN_VIEWS = VIEWS + ["v_event_calendar"]

# --------------------------------------------------------------------------- chain scope

SCOPE_CTES = [
    ("spot", "SELECT date, ticker AS underlying, close AS spot FROM v_bars"),
    ("sc0", f"""
SELECT o.*, s.spot, date_diff('day', o.date, o.expiry) AS dte
FROM v_options o JOIN spot s ON o.date = s.date AND o.underlying = s.underlying
WHERE o.strike BETWEEN s.spot * {Q.lit(1 - CFG.moneyness_band)} AND s.spot * {Q.lit(1 + CFG.moneyness_band)}
  AND o.expiry >= o.date"""),
    ("kr", """
SELECT *, dense_rank() OVER (PARTITION BY date, underlying ORDER BY strike) AS r
FROM (SELECT DISTINCT date, underlying, strike, spot FROM sc0) x"""),
    ("atm", """
SELECT date, underlying, r AS atm_r FROM (
  SELECT *, row_number() OVER (PARTITION BY date, underlying ORDER BY abs(strike - spot), strike) AS rn FROM kr) x
WHERE rn = 1"""),
    ("ksel", f"""
SELECT kr.date, kr.underlying, kr.strike FROM kr JOIN atm USING (date, underlying)
WHERE abs(kr.r - atm.atm_r) <= {CFG.strikes_each_side}"""),
    ("esel", f"""
SELECT date, underlying, expiry, dte FROM (
  SELECT *, dense_rank() OVER (PARTITION BY date, underlying ORDER BY expiry) AS er
  FROM (SELECT DISTINCT date, underlying, expiry, dte FROM sc0 WHERE dte BETWEEN {CFG.min_dte} AND {CFG.max_dte}) x) y
WHERE er <= {CFG.num_expiries}"""),
    ("csel", """
SELECT c.*, row_number() OVER (PARTITION BY date, underlying ORDER BY expiry, strike, contract_type, ticker) AS n,
  count(*) OVER (PARTITION BY date, underlying) AS chain_rows
FROM sc0 c SEMI JOIN ksel USING (date, underlying, strike) SEMI JOIN esel USING (date, underlying, expiry)"""),
]
# A budget of vendor calls small enough to cut chains of the fixture.
ROW_CAP = 2


def _scope(fx):
    return C.chain_scope(fx.v_options, fx.v_bars, CFG)


@register("chain_atm_strikes", Q.build(SCOPE_CTES, select_sql(["~date", "~underlying", "strike"], "ksel"),
                                       views=["v_options", "v_bars"]))
def q_chain_atm_strikes(fx):
    """W14/J-NEAR-K: strikes within 3 ranks of the strike nearest to spot (P6 band applied)."""
    return C.atm_strikes(_scope(fx))


@register("chain_expiries", Q.build(SCOPE_CTES, "SELECT date, underlying, expiry, CAST(dte AS INTEGER) AS dte FROM esel",
                                    views=["v_options", "v_bars"]))
def q_chain_expiries(fx):
    """The nearest 3 expiries with 14 <= DTE <= 60."""
    return C.selected_expiries(_scope(fx))


@register("chain_select", Q.build(SCOPE_CTES, select_sql(
    ["~date", "~ticker", "~underlying", "strike", "~expiry", "~contract_type"], "csel"), views=["v_options", "v_bars"]))
def q_chain_select(fx):
    """J-SEMI: contracts in both windows."""
    return C.chain_select(_scope(fx), CFG).select("date", "ticker", "underlying", "strike", "expiry", "contract_type")


@register("chain_select_capped", Q.build(SCOPE_CTES, select_sql(
    ["~date", "~ticker", "~underlying", f"~greatest(0, chain_rows - {ROW_CAP}) AS cut"], "csel", f"WHERE n <= {ROW_CAP}"),
    views=["v_options", "v_bars"]))
def q_chain_select_capped(fx):
    """The same contracts within a budget of calls per chain, and how many it cuts."""
    return C.chain_select(_scope(fx), CFG.with_(chain_row_cap=ROW_CAP)).select("date", "ticker", "underlying", "cut")


# --------------------------------------------------------------------------- calendar


@register("session_asof", Q.build([
    ("sess", "SELECT DISTINCT date AS s FROM v_bars"),
    ("spine", "SELECT DISTINCT date FROM v_market"),
], """
SELECT d.date,
  (SELECT max(s) FROM sess WHERE s <= d.date) AS last_session,
  CASE WHEN d.date IN (SELECT s FROM sess)
       THEN coalesce((SELECT min(s) FROM sess WHERE s > d.date), d.date + 1) ELSE d.date + 1 END AS next_session
FROM spine d""", views=["v_bars", "v_market"]))
def q_session_asof(fx):
    """J-ASOF / J-ASOF-NEXT: session on or before each date; next session (else date + 1)."""
    return session_asof(fx.v_market.select("date"), fx.v_bars.select("date"))


# --------------------------------------------------------------------------- screen


@register("history_depth", Q.build(Q.screen_ctes(CFG)[1:2], "SELECT date, ticker, history_depth FROM hd",
                                   views=["v_bars"]))
def q_history_depth(fx):
    """A2: running count of stock rows per ticker."""
    return S.history_depth(fx.v_bars)


@register("option_volume_20d", Q.build(Q.screen_ctes(CFG)[:4], select_sql(
    ["~date", "~ticker", "avg_option_volume_20d"], "ov"), views=["v_bars", "v_options"]))
def q_option_volume(fx):
    """A3: mean option volume per contract row over the trailing 20 calendar days."""
    return S.option_volume_20d(S.screening_panel(fx.v_bars, CFG), fx.v_options)


@register("opex_window", Q.build([], f"""
SELECT date, third_friday, abs(date_diff('day', third_friday, date)) <= {CFG.opex_buffer_days} AS in_opex_window
FROM (SELECT date, first_day + CAST((5 - dayofweek(first_day) + 7) % 7 AS INTEGER) + 14 AS third_friday
      FROM (SELECT date, CAST(date_trunc('month', date) AS DATE) AS first_day FROM v_market) x) y""",
    views=["v_market"]))
def q_opex_window(fx):
    """F8: third Friday of the month and the +-3 day opex window."""
    d = F.col("date")
    return fx.v_market.select("date", S.third_friday(d).alias("third_friday"),
                              S.in_opex_window(d, CFG.opex_buffer_days).alias("in_opex_window"))


@register("exclusions", Q.build(Q.screen_ctes(CFG), "SELECT date, ticker, reason, reason IS NULL AS passes FROM excl",
                                views=SCREEN_VIEWS))
def q_exclusions(fx):
    """First failing exclusion rule per screened (date, ticker)."""
    return S.exclusions(S.screening_panel(fx.v_bars, CFG), fx.v_bars, fx.v_options, CFG, events=fx.v_event_calendar)


@register("event_window_exclusion", Q.build(Q.screen_ctes(CFG)[:1], f"""
SELECT p.date, p.ticker FROM panel p WHERE EXISTS (SELECT 1 FROM v_event_calendar e WHERE e.ticker = p.ticker
  AND abs(date_diff('day', e.event_date, p.date)) <= {CFG.earnings_buffer_days})""",
    views=["v_bars", "v_event_calendar"]))
def q_event_window(fx):
    """Screened rows within 5 days of an earnings / ex-dividend event."""
    return S.event_window_exclusion(S.screening_panel(fx.v_bars, CFG), fx.v_event_calendar, CFG)


def _features(fx):
    return features_daily(fx.v_options, fx.v_bars, fx.v_market, CFG)


ACT_CTES = Q.feature_ctes(CFG) + Q.screen_ctes(CFG)[:1] + Q.activity_ctes(CFG)


@register("activity_score", Q.build(ACT_CTES, select_sql(
    ["~date", "~ticker", "z_cp", "z_iv_rank", "z_iv_rv", "activity_score", "score_rel"],
    "act JOIN rel USING (date, ticker, activity_score)"), views=VIEWS, recursive=True))
def q_activity_score(fx):
    """W10 + F12 + J-BENCH: activity score and benchmark-relative score per screened row."""
    panel = S.screening_panel(fx.v_bars, CFG)
    feats = materialize(_features(fx), "features")  # three z streams and the relative score read it
    scores = S.activity_scores(panel, feats, CFG)
    rel = S.relative_scores(panel, feats, CFG).select("date", "ticker", "score_rel")
    return scores.join(rel, ["date", "ticker"])


def _stage(fx):
    # features feed two branches (exclusions' panel and the scores): write them once
    panel = S.screening_panel(fx.v_bars, CFG)
    feats = materialize(_features(fx), "features")
    return S.stage_a(panel, fx.v_bars, fx.v_options, feats, fx.v_market, CFG, events=fx.v_event_calendar)


@register("stage_a_topn", Q.build(Q.stage_a_ctes(CFG), select_sql(
    ["~date", "~ticker", "score_rel", "~CAST(rank AS INTEGER) AS rank", "~n_select"], "stage", "WHERE candidate"),
    views=SCREEN_VIEWS, recursive=True))
def q_stage_a(fx):
    """Per date, passing tickers ranked by relative score; top n = f(VIX)."""
    st = _stage(fx).where("candidate")
    return st.select("date", "ticker", "score_rel", F.col("rank").cast("int").alias("rank"), "n_select")


@register("funnel", Q.build(Q.stage_a_ctes(CFG), """
SELECT s.date, count(*) AS universe_size, CAST(count_if(passes) AS BIGINT) AS after_exclusions,
  CAST(count_if(candidate) AS BIGINT) AS candidates_screened,
  CAST(count_if(candidate AND g.p_magnitude >= 0.55e0) AS BIGINT) AS magnitude_passes
FROM stage s LEFT JOIN v_signals g USING (date, ticker) GROUP BY s.date""",
    views=SCREEN_VIEWS + ["v_signals"], recursive=True))
def q_funnel(fx):
    """Universe / after exclusions / candidates / magnitude passes per date."""
    return S.funnel(_stage(fx), fx.v_signals, CFG)
