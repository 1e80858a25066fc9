"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text becomes one row of statistics, stored once (about 30 numbers a document).
The trees learn from at most about ``TRAIN_ROWS`` distinct labelled rows, weighted by how often
they occur and drawn by a hash (a documented bound: the labelled rows of a 100 TB corpus
would not fit one machine), and every document is scored from its stored row.

Defined results: a null text is empty and is scored like one; null labels are ignored, and
several labels of a document count as their mean; without any label every score is 0.5;
with a null doc_id a row is scored but never learned from; repeated rows are scored alike;
an empty table gives no rows; only doc_id and text are read, so other columns may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewline.llm import docstats, gbdt
from skewline.llm.arrowtext import byte_slices
from skewline.llm.common import Scratch, draw

TRAIN_ROWS = 40_000
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def document_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``stats``, an array of the statistics of ``text``."""
    schema = docs.select(*keep).schema.add("stats", T.ArrayType(T.FloatType()))
    width = len(docstats.NAMES)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                rows = docstats.statistics(part.column(part.num_columns - 1)).astype(np.float32)
                stats = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], stats], names=[*part.schema.names[:-1], "stats"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(tasks, schema)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Trees from the stored statistics of the labelled documents outside the held-out fold."""
    votes = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.avg(F.col("quality").cast("double")).alias("y")).withColumnRenamed("doc_id", "_doc"))
    rows = (stats.where(~held_out(F.col("doc_id"))).join(votes, F.col("doc_id") == F.col("_doc"))
            .select("stats", (F.col("y") >= 0.5).alias("y")))
    got = draw(rows, train_rows).toArrow().combine_chunks().sort_by("place")
    return gbdt.fit(matrix(got["stats"], len(docstats.NAMES)), got["y"].to_numpy().astype(float), got["weight"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and the columns ``keep`` of ``docs`` with held_out, score and predicted."""
    keep = [c for c in (keep or []) if c not in ("doc_id", "stats", "held_out", "score", "predicted")]
    names = ["doc_id", *keep]
    stats = Scratch(docs.sparkSession, "quality").store(document_statistics(docs, names))
    model = fit(stats, labels, train_rows)
    schema = stats.select(*names).schema.add("score", "double")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = gbdt.predict(model, matrix(batch.column(batch.num_columns - 1), len(docstats.NAMES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*names, "score"])

    return (stats.select(*names, "stats").mapInArrow(tasks, schema)
            .select("doc_id", *keep, held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores 0.5 or more.  Statistics
    are computed again in the scoring pass rather than storing every text beside them."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.store(document_statistics(docs, ["doc_id"]))
    model = fit(stats, labels, train_rows)
    scratch.drop(stats)
    at = docs.columns.index("text")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                x = docstats.statistics(part.column(at)).astype(np.float32).astype(np.float64)
                yield part.filter(pa.array(gbdt.predict(model, x) >= 0.5))

    return docs.mapInArrow(tasks, docs.schema)
