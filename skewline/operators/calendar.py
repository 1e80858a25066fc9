"""Trading-calendar look-ups (J-ASOF, J-ASOF-NEXT).

The calendar has one row per date, so it is a dimension whose size is the number
of days covered; its ordered window runs in one task by design.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_asof(dates: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each date: the latest session on or before it, and the next session after it
    when the date is itself a session (else the next calendar day)."""
    d = dates.select("date").distinct().withColumn("_q", F.lit(True))
    s = sessions.select("date").distinct().withColumn("_s", F.lit(True))
    tl = d.join(s, "date", "full")
    w = Window.orderBy("date")
    is_s = F.coalesce(F.col("_s"), F.lit(False))
    last = F.last(F.when(is_s, F.col("date")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(F.when(is_s, F.col("date")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = tl.select("date", "_q", last.alias("last_session"),
                    F.when(is_s, F.coalesce(nxt, F.date_add("date", 1))).otherwise(F.date_add("date", 1))
                    .alias("next_session"))
    return out.where(F.col("_q")).drop("_q")
