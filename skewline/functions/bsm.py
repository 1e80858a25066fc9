"""Black-Scholes-Merton pricing pieces.

Three forms of the same arithmetic:

* Column expressions (``norm_cdf``, ``bsm_delta``, ``bsm_gamma``) that stay inside
  whole-stage codegen;
* numpy kernels (``np_norm_cdf``, ``np_bsm_price``, ``np_implied_vol``) used by the
  Arrow ``pandas_udf`` for the one step Catalyst cannot express efficiently: the
  root search of implied volatility;
* the pandas UDF ``implied_vol_udf`` itself.

All three evaluate operations in the same order so that a SQL re-statement of the
bisection lands on the same binary answer.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import cloudpickle

# Ship this module's code with the UDF itself, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Hart (1968) double-precision rational approximation of the normal
# tail as published by West (2005), "Better approximations to cumulative normal
# functions".  Numerator coefficients, highest power first:
CDF_NUM = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
# Denominator coefficients, highest power first:
CDF_DEN = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
CDF_SPLIT = 7.07106781186547  # switch to the continued fraction beyond this |x|
CDF_ZERO = 37.0  # tail is exactly 0 in double precision beyond this |x|
SQRT_2PI = 2.506628274631  # as used by the continued-fraction branch
SQRT_2PI_FULL = math.sqrt(2.0 * math.pi)

# Bisection bracket and step count for implied volatility.  The lower end sits
# below the 0.01 clamp so the clamp, not the bracket, decides the NULL.
IV_LO = 0.001
IV_HI = 6.0
IV_STEPS = 52


def _horner(coefs, x):
    acc = coefs[0] * x + coefs[1]
    for c in coefs[2:]:
        acc = acc * x + c
    return acc


# --------------------------------------------------------------------------- Column


def norm_cdf(x: Column) -> Column:
    """Standard normal CDF as a Column expression."""
    ax = F.abs(x)
    expo = F.exp(-(ax * ax) / F.lit(2.0))
    near = expo * _horner(CDF_NUM, ax) / _horner(CDF_DEN, ax)
    b = ax + F.lit(0.65)
    b = ax + F.lit(4.0) / b
    b = ax + F.lit(3.0) / b
    b = ax + F.lit(2.0) / b
    b = ax + F.lit(1.0) / b
    far = expo / b / F.lit(SQRT_2PI)
    tail = F.when(ax > F.lit(CDF_ZERO), F.lit(0.0)).when(ax < F.lit(CDF_SPLIT), near).otherwise(far)
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-(x * x) / F.lit(2.0)) / F.lit(SQRT_2PI_FULL)


def d1(S: Column, K: Column, T_: Column, r: Column, sigma: Column) -> Column:
    return (F.log(S / K) + (r + F.lit(0.5) * sigma * sigma) * T_) / (sigma * F.sqrt(T_))


def _valid(S, K, T_, sigma):
    return (T_ > 0) & (sigma > 0) & (S > 0) & (K > 0)


def bsm_delta(S, K, T_, r, sigma, flag: Column) -> Column:
    """N(d1) for calls, N(d1) - 1 for puts; NULL when T, sigma, S or K <= 0."""
    n1 = norm_cdf(d1(S, K, T_, r, sigma))
    val = F.when(flag.isin("call", "c"), n1).otherwise(n1 - F.lit(1.0))
    return F.when(_valid(S, K, T_, sigma), val)


def bsm_gamma(S, K, T_, r, sigma) -> Column:
    """phi(d1) / (S sigma sqrt(T))."""
    val = norm_pdf(d1(S, K, T_, r, sigma)) / (S * sigma * F.sqrt(T_))
    return F.when(_valid(S, K, T_, sigma), val)


def year_fraction(as_of: Column, expiry: Column) -> Column:
    """max(days / 365.25, 1 / 365.25)."""
    return F.greatest(F.datediff(expiry, as_of) / F.lit(365.25), F.lit(1.0 / 365.25))


# --------------------------------------------------------------------------- numpy


def np_norm_cdf(x: np.ndarray) -> np.ndarray:
    ax = np.abs(x)
    expo = np.exp(-(ax * ax) / 2.0)
    near = expo * _horner(CDF_NUM, ax) / _horner(CDF_DEN, ax)
    with np.errstate(divide="ignore", invalid="ignore"):
        b = ax + 0.65
        b = ax + 4.0 / b
        b = ax + 3.0 / b
        b = ax + 2.0 / b
        b = ax + 1.0 / b
        far = expo / b / SQRT_2PI
    tail = np.where(ax > CDF_ZERO, 0.0, np.where(ax < CDF_SPLIT, near, far))
    return np.where(x > 0, 1.0 - tail, tail)


def np_bsm_price(S, K, T_, r, sigma, is_call):
    sqrt_t = np.sqrt(T_)
    d_1 = (np.log(S / K) + (r + 0.5 * sigma * sigma) * T_) / (sigma * sqrt_t)
    d_2 = d_1 - sigma * sqrt_t
    disc = K * np.exp(-r * T_)
    call = S * np_norm_cdf(d_1) - disc * np_norm_cdf(d_2)
    put = disc * np_norm_cdf(-d_2) - S * np_norm_cdf(-d_1)
    return np.where(is_call, call, put)


def _horner_inplace(coefs, x, out):
    """``_horner`` with the same operations in the same order, into ``out``."""
    np.multiply(x, coefs[0], out=out)
    out += coefs[1]
    for c in coefs[2:]:
        out *= x
        out += c
    return out


def np_norm_tail(ax: np.ndarray) -> np.ndarray:
    """Upper tail 1 - N(|x|) of the West (2005) recipe, for ax = |x| >= 0.

    N(x) = 1 - tail for x > 0, else tail; so N(x) and N(-x) come from one tail
    evaluation, bit-identical to ``np_norm_cdf``.  The continued-fraction branch is
    evaluated only where it applies."""
    expo = ax * ax
    expo *= -1.0
    expo /= 2.0
    np.exp(expo, out=expo)
    num = _horner_inplace(CDF_NUM, ax, np.empty_like(ax))
    den = _horner_inplace(CDF_DEN, ax, np.empty_like(ax))
    num *= expo
    num /= den
    tail = num
    far = ax >= CDF_SPLIT
    if far.any():
        a = ax[far]
        b = a + 0.65
        b = a + 4.0 / b
        b = a + 3.0 / b
        b = a + 2.0 / b
        b = a + 1.0 / b
        tail[far] = np.where(a > CDF_ZERO, 0.0, expo[far] / b / SQRT_2PI)
    return tail


def _cdf_pair(d, tail):
    """(N(d), N(-d)) from the shared tail."""
    return np.where(d > 0, 1.0 - tail, tail), np.where(-d > 0, 1.0 - tail, tail)


def np_implied_vol(price, S, K, T_, r, is_call, clamp_min=0.01, clamp_max=5.0):
    """F3 with the P9 guards: vectorised bisection, NaN where no valid IV exists.

    Each step evaluates the BSM price at the bracket midpoint with the same operation
    order as ``np_bsm_price`` (and the SQL statement of the oracle), so results are
    bit-identical to the straightforward form; only rows passing the guards iterate."""
    price = np.asarray(price, dtype="float64")
    S = np.asarray(S, dtype="float64")
    K = np.asarray(K, dtype="float64")
    T_ = np.asarray(T_, dtype="float64")
    r = np.asarray(r, dtype="float64")
    is_call = np.asarray(is_call, dtype=bool)
    out = np.full(price.shape, np.nan)
    with np.errstate(all="ignore"):
        ok = (price > 0) & (T_ > 0) & (S > 0) & (K > 0)
        ok &= np.where(is_call, price < S, price < K)
        ok &= np.isfinite(price) & np.isfinite(S) & np.isfinite(K) & np.isfinite(T_) & np.isfinite(r)
        idx = np.nonzero(ok)[0]
        if idx.size == 0:
            return out
        s, k, t, rr, px, call = S[idx], K[idx], T_[idx], r[idx], price[idx], is_call[idx]
        sqrt_t = np.sqrt(t)
        log_sk = np.log(s / k)
        disc = k * np.exp(-rr * t)
        lo = np.full(idx.shape, IV_LO)
        hi = np.full(idx.shape, IV_HI)
        for _ in range(IV_STEPS):
            mid = (lo + hi) / 2.0
            d_1 = (log_sk + (rr + 0.5 * mid * mid) * t) / (mid * sqrt_t)
            d_2 = d_1 - mid * sqrt_t
            n1, m1 = _cdf_pair(d_1, np_norm_tail(np.abs(d_1)))
            n2, m2 = _cdf_pair(d_2, np_norm_tail(np.abs(d_2)))
            pr = np.where(call, s * n1 - disc * n2, disc * m2 - s * m1)
            above = pr > px
            hi = np.where(above, mid, hi)
            lo = np.where(above, lo, mid)
        iv = (lo + hi) / 2.0
        out[idx] = np.where((iv >= clamp_min) & (iv <= clamp_max), iv, np.nan)
    return out


def implied_vol(price: Column, S: Column, K: Column, T_: Column, r: Column, flag: Column, clamp_min: float = 0.01,
                clamp_max: float = 5.0) -> Column:
    """Implied volatility; NULL where the guards fail or it leaves [clamp_min, clamp_max].

    The guards are column expressions: rows that fail them reach the Arrow worker as
    NULLs, which it passes over."""
    is_call = flag.isin("call", "c")
    guards = (price > 0) & (T_ > 0) & (S > 0) & (K > 0) & (price < F.when(is_call, S).otherwise(K))

    @F.pandas_udf(T.DoubleType())
    def solve(price: pd.Series, S: pd.Series, K: pd.Series, T_: pd.Series, r: pd.Series, call: pd.Series) -> pd.Series:
        price, S, K, T_, r = (x.to_numpy(dtype="float64", na_value=np.nan) for x in (price, S, K, T_, r))
        iv = np_implied_vol(price, S, K, T_, r, call.fillna(False).to_numpy(dtype=bool), clamp_min, clamp_max)
        return pd.Series(iv)  # NaN leaves the UDF as NULL (Arrow null mask)

    return solve(F.when(guards, price), S, K, T_, r, is_call)
