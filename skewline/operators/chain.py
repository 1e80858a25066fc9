"""Option-chain operators: pricing (F1-F6, P9, P10), chain scope (P6-P8, W14-W16),
nearest-contract look-ups (J-NEAR-*), call/put volume (A4) and derived chain
features (F10, F11).

A chain is all contracts of one underlying on one date.  Every chain operator is
keyed by (date, underlying), so contract-level work spreads over dates x
underlyings before anything is shuffled by ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings
from skewline.functions.bsm import bsm_delta, bsm_gamma, implied_vol, year_fraction

CHAIN = ("date", "underlying")


def spot_prices(bars: DataFrame) -> DataFrame:
    """J-MAP: the underlying's close on the same date."""
    return bars.select("date", F.col("ticker").alias("underlying"), F.col("close").alias("spot"))


def risk_free(market: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """J-SCALAR source: that date's T-bill (already a fraction)."""
    return market.select("date", F.col("t_bill_3m").alias("_tbill"))


def price_contracts(options: DataFrame, bars: DataFrame, market: DataFrame, cfg: Settings = DEFAULT,
                    how: str = "inner") -> DataFrame:
    """contract_iv / contract_greeks.

    ``how='inner'`` keeps only contracts whose underlying has a bar that day (P10: the
    others are left untouched by the update); ``how='left'`` keeps every contract with
    NULL pricing where the spot is missing.  Spot and rate sides are one row per
    (date, ticker) / date; AQE turns those joins into broadcasts when the measured
    side is small and keeps a shuffle join otherwise.
    """
    px = (
        options.join(spot_prices(bars), list(CHAIN), how)
        .join(risk_free(market, cfg), "date", "left")
        .withColumn("r", F.coalesce(F.col("_tbill"), F.lit(cfg.default_risk_free_rate)))
        .drop("_tbill")
    )
    if how == "inner":
        px = px.where(F.col("spot").isNotNull() & F.col("open").isNotNull() & F.col("close").isNotNull())
    px = px.withColumns({"mid_price": (F.col("open") + F.col("close")) / F.lit(2.0),
                         "t_years": year_fraction(F.col("date"), F.col("expiry"))})
    px = px.withColumn(
        "iv_computed",
        implied_vol(F.col("mid_price"), F.col("spot"), F.col("strike"), F.col("t_years"), F.col("r"),
                    F.col("contract_type"), cfg.iv_clamp_min, cfg.iv_clamp_max),
    )
    S, K, T_, r, iv = (F.col(c) for c in ("spot", "strike", "t_years", "r", "iv_computed"))
    return px.withColumns({"delta": F.when(iv.isNotNull(), bsm_delta(S, K, T_, r, iv, F.col("contract_type"))),
                           "gamma": F.when(iv.isNotNull(), bsm_gamma(S, K, T_, r, iv))})


# --------------------------------------------------------------------------- chain scope


def chain_scope(options: DataFrame, bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """P6 + W14 + W15 + P7 flags for every contract of every chain, in one window pass.

    Adds: spot, dte, strike_rank, atm_rank, in_strike_window, expiry_rank, in_expiry_window.
    """
    band = cfg.moneyness_band
    c = options.join(spot_prices(bars), list(CHAIN), "inner").where(
        F.col("strike").between(F.col("spot") * (1 - band), F.col("spot") * (1 + band))
        & (F.col("expiry") >= F.col("date"))
    )
    c = c.withColumn("dte", F.datediff("expiry", "date"))
    w_chain = Window.partitionBy(*CHAIN)
    c = c.withColumn("strike_rank", F.dense_rank().over(w_chain.orderBy("strike")))
    # nearest strike to spot, lower strike on ties
    c = c.withColumn(
        "atm_rank",
        F.min_by("strike_rank", F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))).over(w_chain),
    )
    c = c.withColumn("in_strike_window", F.abs(F.col("strike_rank") - F.col("atm_rank")) <= cfg.strikes_each_side)
    in_dte = F.col("dte").between(cfg.min_dte, cfg.max_dte)
    c = c.withColumn(
        "expiry_rank",
        F.when(in_dte, F.dense_rank().over(w_chain.orderBy(F.when(in_dte, F.col("expiry")).asc_nulls_last()))),
    )
    return c.withColumn("in_expiry_window", F.coalesce(F.col("expiry_rank") <= cfg.num_expiries, F.lit(False)))


def atm_strikes(scope: DataFrame) -> DataFrame:
    return scope.where("in_strike_window").select(*CHAIN, "strike").distinct()


def selected_expiries(scope: DataFrame) -> DataFrame:
    return scope.where("in_expiry_window").select(*CHAIN, "expiry", "dte").distinct()


def chain_select(scope: DataFrame, cfg: Settings = DEFAULT, apply_staleness: bool = False) -> DataFrame:
    """J-SEMI (+ P8): contracts in both windows.  W16: with ``cfg.chain_row_cap`` the first
    so many of a chain in a fixed order, and ``cut`` says how many the cap removed."""
    sel = scope.where(F.col("in_strike_window") & F.col("in_expiry_window"))
    if cfg.chain_row_cap is not None:
        chain = Window.partitionBy(*CHAIN)
        w = chain.orderBy("expiry", "strike", "contract_type", "ticker")
        sel = sel.withColumns({"_n": F.row_number().over(w), "cut": F.greatest(F.lit(0), F.count(F.lit(1)).over(chain) - cfg.chain_row_cap)})
        sel = sel.where(F.col("_n") <= cfg.chain_row_cap).drop("_n")
    if apply_staleness:
        sel = sel.where(F.col("transactions") >= cfg.min_transactions_for_iv)
    return sel


# --------------------------------------------------------------------------- chain summary


def _nearest(value: str, cond: Column, dist: Column) -> Column:
    """J-NEAR: ``value`` of the row minimising ``dist`` among rows meeting ``cond``;
    ties go to the earliest expiry, then lowest strike, then contract ticker."""
    return F.min_by(value, F.when(cond, F.struct(dist, F.col("expiry"), F.col("strike"), F.col("ticker"))))


def chain_summary(priced: DataFrame) -> DataFrame:
    """One aggregation per chain: four delta targets, two DTE targets, call/put volume.

    ``min_by`` and ``sum`` are partial aggregates, so each task combines its chains
    before the (date, underlying) shuffle.
    """
    iv, delta = F.col("iv_computed"), F.col("delta")
    typ = F.col("contract_type")
    has_d = iv.isNotNull() & delta.isNotNull()
    dte = F.datediff("expiry", "date")
    return priced.groupBy(*CHAIN).agg(
        _nearest("iv_computed", has_d & (typ == "call"), F.abs(delta - F.lit(0.5))).alias("iv_call_50"),
        _nearest("iv_computed", has_d & (typ == "put"), F.abs(delta - F.lit(-0.5))).alias("iv_put_50"),
        _nearest("iv_computed", has_d & (typ == "call"), F.abs(delta - F.lit(0.25))).alias("iv_call_25"),
        _nearest("iv_computed", has_d & (typ == "put"), F.abs(delta - F.lit(-0.25))).alias("iv_put_25"),
        _nearest("iv_computed", iv.isNotNull(), F.abs(dte - F.lit(30))).alias("iv_30"),
        _nearest("iv_computed", iv.isNotNull(), F.abs(dte - F.lit(60))).alias("iv_60"),
        F.coalesce(F.sum(F.when(typ == "call", F.col("volume"))), F.lit(0.0)).alias("call_volume"),
        F.coalesce(F.sum(F.when(typ == "put", F.col("volume"))), F.lit(0.0)).alias("put_volume"),
    )


def price_chains(options: DataFrame, bars: DataFrame, market: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Summary of all chains.  Contracts are dealt by chain before they are priced: ``min_by`` on several
    columns is aggregated by sorting, and a shuffle partition sorts in memory where a scan task of
    whole files would spill its priced rows."""
    used = ["date", "ticker", "underlying", "strike", "expiry", "contract_type", "open", "close", "volume"]
    return chain_summary(price_contracts(options.select(*used).repartition(*CHAIN), bars, market, cfg, how="left"))


def truthy(c: Column) -> Column:
    """Python truthiness of an optional number: non-NULL and non-zero."""
    return c.isNotNull() & (c != 0)


def chain_features(summary: DataFrame) -> DataFrame:
    """F10/F11/A4 on a chain summary."""
    c = F.col
    return summary.select(
        *CHAIN,
        F.when(c("iv_call_50").isNotNull(), c("iv_call_50")).otherwise(c("iv_30")).alias("iv_atm_30dte"),
        F.when(truthy(c("iv_put_25")) & truthy(c("iv_call_25")), c("iv_put_25") - c("iv_call_25")).alias("skew_25d"),
        F.when(truthy(c("iv_60")) & truthy(c("iv_30")) & (c("iv_30") > 0), c("iv_60") / c("iv_30")).alias(
            "term_structure_60_30"),
        F.when(truthy(c("iv_call_50")) & truthy(c("iv_put_50")), c("iv_call_50") - c("iv_put_50")).alias(
            "cw_iv_spread"),
        c("call_volume"),
        c("put_volume"),
        F.when(c("put_volume") > 0, c("call_volume") / c("put_volume")).alias("call_put_volume_ratio"),
    )
