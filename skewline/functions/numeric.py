"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d.  Every step is one IEEE operation, so any engine
    evaluating the same steps returns the same double (unlike decimal-string rounding)."""
    scale = float(10.0 ** digits)
    return F.when(F.abs(c) < 1e12, F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).otherwise(c)
