"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with one scale each.  With u = s q + e, the product of
two unit vectors differs from s s' <q, q'> by at most |s q| |e'| + |e|, so every pair whose
quantised product plus that bound stays below the threshold is certainly no link; only the
others are computed again in double precision.

Equal vectors of a label are one representative with a count, so groups of copies cost one
row.  The representatives of a (label, dimension) are dealt into blocks of about
``BLOCK``; a task multiplies one pair of blocks and returns, per vector with a link, its number
of links there and the least id of its component there: two numbers a vector, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and vectors with a null label or vec_id, link with nothing; vectors of different lengths
do not link; repeated rows (equal vec_id, label and vector) are one vector; rows that share
a vec_id but not the vector are vectors of their own; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.llm.common import Scratch
from skewline.llm.components import least_reachable

THRESHOLD = 0.98
BLOCK = 1024
PAIRS_AT_ONCE = 1 << 18


def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, dimension, digest and float64 bytes; the last three null where the
    vector can't link."""
    for batch in batches:
        ids, labels, dims, digests, raws = [], [], [], [], []
        for vec_id, label, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            ids.append(vec_id)
            labels.append(label)
            x = None
            if vec_id is not None and label is not None and vector.is_valid and len(vector.values) and not vector.values.null_count:
                x = vector.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
            if x is None or not np.isfinite(x).all() or not x.any():
                dims.append(None), digests.append(None), raws.append(None)
            else:
                raw = x.tobytes()
                dims.append(len(x)), raws.append(raw)
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()),
                                          pa.array(digests, pa.binary()), pa.array(raws, pa.binary())],
                                         names=["vec_id", "label", "dim", "digest", "raw"])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, int8 rows, scales, lengths of the quantised rows, lengths of the errors."""
    x = x / np.abs(x).max(1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    back = q * s[:, None]
    return u, q, s, np.linalg.norm(back, axis=1), np.linalg.norm(u - back, axis=1)


def linked_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of the linked pairs (i of a, j of b; i < j within a if b is None) and how
    many pairs were computed in double precision."""
    ua, qa, sa, la, ea = quantise(a)
    ub, qb, sb, lb, eb = (ua, qa, sa, la, ea) if b is None else quantise(b)
    # Sums of int8 products are exact in float32 below 2 ** 24.
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    left, right = qa.astype(kind), qb.astype(kind).T.copy()
    found_i, found_j, computed = [], [], 0
    rows = max(1, PAIRS_AT_ONCE // max(1, len(ub)))
    for at in range(0, len(ua), rows):
        part = slice(at, at + rows)
        bound = (left[part] @ right).astype(np.float64) * sa[part, None] * sb
        bound += la[part, None] * eb + ea[part, None] + 1e-12
        i, j = np.nonzero(bound >= threshold)
        i += at
        if b is None:
            i, j = i[i < j], j[i < j]
        computed += len(i)
        hit = np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
        found_i.append(i[hit])
        found_j.append(j[hit])
    return np.concatenate(found_i), np.concatenate(found_j), computed


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least position reachable from each of ``n`` positions over the pairs (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _tile(threshold: float):
    def tile(table: pa.Table) -> pa.Table:
        rep, copies, side = (table[c].to_numpy() for c in ("rep", "copies", "side"))
        x = np.frombuffer(b"".join(table["raw"].to_pylist()), "<f8").reshape(len(rep), -1)
        order = np.lexsort((rep, side))
        rep, copies, side, x = rep[order], copies[order], side[order], x[order]
        cut = int(np.searchsorted(side, 1))
        empty = np.zeros(0, np.int64)
        if side[0] == 2:  # a block with itself
            i, j, _ = linked_pairs(x, None, threshold)
        elif 0 < cut < len(rep):
            i, j, _ = linked_pairs(x[:cut], x[cut:], threshold)
            j = j + cut
        else:
            i = j = empty
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        by_id = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[by_id] = np.arange(len(rep))
        root = rep[by_id][least_labels(len(rep), rank[i], rank[j])[rank]]
        has = links > 0
        return pa.table({"rep": rep[has], "links": links[has].astype(np.int64), "root": root[has]})

    return tile


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    scratch = Scratch(embeddings.sparkSession, "embeddings")
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"),
                             F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.store(rows.mapInArrow(prepare, "vec_id long, label string, dim int, digest binary, raw binary"))
    keys = ["label", "dim", "digest"]
    members = rows.where("digest is not null").select("vec_id", *keys).distinct()
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"))
    vectors = rows.where("digest is not null").groupBy(*keys).agg(F.first("raw").alias("raw"))
    reps = scratch.store(counts.join(vectors, keys))
    blocks = (reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (reps.join(blocks, ["label", "dim"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                     F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
                     "rep", "copies", "raw"))
    found = scratch.store(dealt.groupBy("label", "dim", "low", "high")
                          .applyInArrow(_tile(threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = least_reachable(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (reps.select(*keys, "rep", "copies").join(links, "rep", "left")
             .join(components.withColumnRenamed("id", "rep"), "rep", "left")
             .select(*keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    linked = members.join(known, keys).select("vec_id", "n_links", "component_id")
    alone = (rows.where("digest is null").select("vec_id").distinct()
             .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
