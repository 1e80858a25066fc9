"""Connected components of a stored edge table by least labels with pointer jumping.

Every round is two joins and an aggregate with map-side combine; labels and edges stay in
distributed tables in the shared folder, so no component is ever gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.llm.common import Scratch


def least_reachable(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in the columns a, b of ``edges``: the least id that
    can be reached from it."""
    scratch = Scratch(edges.sparkSession, "components")
    both = scratch.store(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.store(both.groupBy("a").agg(F.min("b").alias("m"))
                           .select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy("a").agg(F.min("component").alias("near")))
        hooked = (labels.join(near.withColumnRenamed("a", "id"), "id")
                  .select("id", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        # Follow the new label's own label: distances halve every round.
        jumped = (hooked.join(labels.select(F.col("id").alias("component"), F.col("component").alias("next")), "component")
                  .select("id", "old", F.least("component", "next").alias("component")))
        new = scratch.store(jumped)
        changed = new.where("component <> old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not changed:
            scratch.drop(both)
            return labels.select("id", "component")
