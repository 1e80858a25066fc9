"""Run-time parameters.  One frozen dataclass; every operator takes it explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The fifteen model features, in model order.
FEATURE_NAMES = (
    "iv_atm_30dte",
    "iv_pct_rank_252d",
    "z_iv_minus_ewma_rv",
    "skew_pct_rank_252d",
    "term_structure_60_30",
    "z_call_put_volume_ratio",
    "z_5d_return",
    "vix_level",
    "z_vix_3d_change",
    "vix3m_level",
    "z_hy_oas_5d_change",
    "dspx_level",
    "cor1m_level",
    "z_realized_vol_20d",
    "cw_iv_spread",
)
STAGE_C_FEATURES = FEATURE_NAMES
STAGE_B_FEATURES = tuple(f for f in FEATURE_NAMES if f != "cw_iv_spread")


@dataclass(frozen=True)
class Settings:
    # Thresholds of the signal engine.
    benchmark_ticker: str = "T0"
    horizon_days: int = 5
    base_rate_target: float = 0.30
    stage_b_threshold: float = 0.55
    direction_hit_rate_target: float = 0.55
    min_option_volume_20d: float = 500.0
    min_transactions_for_iv: int = 10
    min_history_days: int = 252
    opex_buffer_days: int = 3
    earnings_buffer_days: int = 5
    stage_a_base: int = 5
    stage_a_slope: int = 5
    stage_a_max: int = 25
    strikes_each_side: int = 3
    num_expiries: int = 3
    min_dte: int = 14
    max_dte: int = 60
    chain_row_cap: int | None = None  # a budget of vendor calls, no analytic rule; off by default
    moneyness_band: float = 0.15
    ewma_lambda: float = 0.94
    default_risk_free_rate: float = 0.05
    iv_clamp_min: float = 0.01
    iv_clamp_max: float = 5.0
    default_realized_vol: float = 0.2
    default_sigma_window: float = 0.02
    default_k_threshold: float = 1.5
    iv_baseline_min_auc_lift: float = 0.03
    training_window_years: int = 2
    cv_n_folds: int = 5
    cv_embargo_days: int = 5
    refit_frequency_months: int = 3
    calibration_error_max: float = 0.10
    hit_rate_min: float = 0.50
    marginal_auc_min: float = 0.02
    ks_drift_alert: float = 0.25
    ks_drift_pause: float = 0.30
    # Windows
    rolling_window: int = 252
    rolling_min_periods: int = 60
    screen_z_min_periods: int = 20
    rv_window: int = 20
    trading_days: int = 252
    # k calibration grid and direction grid
    k_grid: tuple = (0.5, 3.0, 50)
    direction_grid: tuple = (0.35, 0.65, 30)
    # Model
    gbt_max_iter: int = 100
    gbt_max_depth: int = 4
    gbt_step_size: float = 0.1
    seed: int = 42
    # Choices where the reference and its spec disagree (see README)
    entry_price: str = "open"  # 'close' reproduces the reference code
    activity_rv_column: str = "iv_minus_ewma_rv"  # 'z_iv_minus_ewma_rv' = reference code
    stage_b_features: tuple = field(default=STAGE_B_FEATURES)
    stage_c_features: tuple = field(default=STAGE_C_FEATURES)

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)


DEFAULT = Settings()
