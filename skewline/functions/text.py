"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECRET_PARAM = r"(?i)([?&]apiKey=)[^&\s\"']+"


def redact_secrets(text: Column, literal_key: str | None = None) -> Column:
    """replace the configured key anywhere, then any ``apiKey=`` query value."""
    t = text
    if literal_key:
        t = F.replace(t, F.lit(literal_key), F.lit("[REDACTED]"))
    return F.regexp_replace(t, SECRET_PARAM, "$1[REDACTED]")
