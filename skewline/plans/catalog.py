"""Registered queries: each reads the driver's tables through the fixture views and
returns a DataFrame; most have a SQL statement of the same result for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewline import sqlcheck as Q
from skewline.config import DEFAULT
from skewline.functions.numeric import round_half_up
from skewline.session import apply_engine_conf
from skewline.sources.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CFG = DEFAULT


def r6(c, digits: int = Q.ROUND):
    """The same IEEE steps as the SQL side (see sqlcheck.r6)."""
    return round_half_up(c, digits)


def finish(df: DataFrame, digits: int = Q.ROUND) -> DataFrame:
    """Round every double column (value-hash comparison across engines)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(r6(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_engine_conf(spark)
            return finish(fn(Fixtures(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def select_sql(cols: list[str], source: str, where: str = "") -> str:
    """SELECT list rounding the named double columns."""
    parts = []
    for c in cols:
        if c.startswith("~"):
            parts.append(c[1:])
        elif " AS " in c:
            expr, alias = c.rsplit(" AS ", 1)
            parts.append(Q.rnd(expr, alias))
        else:
            parts.append(Q.rnd(c, c.split(".")[-1]))
    return f"SELECT {', '.join(parts)} FROM {source} {where}"


from skewline.plans import queries_windows  # noqa: E402,F401  (registers)
from skewline.plans import queries_screen  # noqa: E402,F401
from skewline.plans import queries_targets  # noqa: E402,F401
from skewline.plans import queries_stats  # noqa: E402,F401
from skewline.plans import queries_sources  # noqa: E402,F401
from skewline.plans import queries_output  # noqa: E402,F401
from skewline.plans import queries_models  # noqa: E402,F401
from skewline.plans import queries_streaming  # noqa: E402,F401
