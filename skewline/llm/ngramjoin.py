"""N-gram Jaccard join by chosen paths: all documents whose sets of five-word shingles have
Jaccard similarity 0.8 or more.

Every set is embedded as ``TOKENS`` (position, least hash) tokens; two sets share a token
with probability equal to their similarity J.  A run starts with all sets in one node.  A
node samples 1.25 = 1 / 0.8 positions on average, and each sampled position sends a set to
the child named by the set's token there, so a pair with J >= 0.8 is expected to meet in
one child at least.  Nodes of at most ``BUCKET`` sets are leaves; larger ones split again, down to
``DEPTH``, below which they are compared in blocks of ``BUCKET``, so nothing is capped.  ``runs``
follows from the target recall (see ``runs_needed``).

A pair may meet in many leaves.  It is counted in the least leaf that holds both, which
each leaf decides from the leaf lists that its sets carry; so links are summed without ever
emitting pairs.  Leaves compare sketches first; sets with a candidate bring their whole
shingles, and similarities are then exact (over 32-bit shingle hashes).  A leaf returns, per set,
its links and the least id of its component there.

Sets that are equal are one representative with a count.  Words are runs of characters
other than ASCII white space; a text of 1 to 4 words has one shingle, all its words.

Defined results: null and empty texts and texts without words have no shingles and link
with nothing, nor do rows with a null doc_id; repeated rows (equal doc_id and text) are one
document; rows that share a doc_id but not the text are documents of their own in one class;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skewline.llm.arrowtext import byte_slices, mix, shingles, text_bytes, word_hashes, words
from skewline.llm.common import Scratch
from skewline.llm.components import least_reachable
from skewline.llm.neardup_embeddings import least_labels

WORDS = 5
THRESHOLD = 0.8
TOKENS = 64
BUCKET = 256
DEPTH = 4
RECALL = 0.9999
# Part of the pairs that may be lost, spent on pairs with fewer equal tokens than a candidate has.
SLACK = 0.1
PAIRS_AT_ONCE = 1 << 17
# Pairs of one group from which one matrix product replaces comparing lists pair by pair.
DENSE = 2048
TILE = ["path", "low", "high"]

_U = np.uint64
_rng = np.random.default_rng(20240611)
_MULTIPLY = _rng.integers(1 << 62, 1 << 63, TOKENS, dtype=_U) | _U(1)
_ADD = _rng.integers(0, 1 << 63, TOKENS, dtype=_U)
_ORDER = _rng.permutation(TOKENS)


def runs_needed(threshold: float = THRESHOLD, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold is found with probability ``recall``, if all
    its nodes split down to ``depth``: one or (once in four) two positions a node.  All runs
    share one sketch, so a pair's chance is averaged over how many tokens it shares, and
    pairs with fewer than a candidate may have count as lost."""
    second = 1 / threshold - 1
    shared = np.arange(TOKENS + 1)
    chance = np.array([comb(TOKENS, k) * threshold ** k * (1 - threshold) ** (TOKENS - k) for k in shared])
    chance[shared < least_shared(threshold, recall)] = 0
    meet = np.ones(TOKENS + 1)
    for _ in range(depth - 1):
        child = shared / TOKENS * meet
        meet = (1 - second) * child + second * (1 - (1 - child) ** 2)
    runs, missed = 0, np.ones(TOKENS + 1)
    while chance @ (1 - missed) < recall:
        missed *= (1 - shared / TOKENS * meet) ** len(_root(runs, threshold)[1])
        runs += 1
    return runs


def _root(run: int, threshold: float) -> tuple[np.ndarray, list[int]]:
    """Path and positions of a run's root.  Runs start from different positions; the second
    one is drawn as in any node."""
    root = mix(np.array([run + 1], _U))
    _, drawn = _positions(root, threshold)
    return root, sorted({int(_ORDER[run % TOKENS]), *map(int, drawn[1:])})


def least_shared(threshold: float, recall: float = RECALL) -> int:
    """Equal tokens that a candidate pair has at least: a pair at the threshold has fewer with a
    chance of ``SLACK`` times 1 - ``recall`` at most."""
    below, k = (1 - threshold) ** TOKENS, 0
    while below <= SLACK * (1 - recall):
        k += 1
        below += comb(TOKENS, k) * threshold ** k * (1 - threshold) ** (TOKENS - k)
    return k


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, number of shingles, digest of the set, sketch and the sorted shingle hashes."""
    for batch in batches:
        for part in byte_slices(batch, "text"):
            n = part.num_rows
            data, offs = text_bytes(part.column(1))
            starts, ends, first = words(data, offs)
            hashes, doc = shingles(word_hashes(data, starts, ends), first, WORDS)
            key = np.unique((doc.astype(_U) << _U(32)) | (hashes >> _U(32)))
            doc, value = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF))
            size = np.bincount(doc, minlength=n)
            sketch = np.zeros((n, TOKENS), "<u4")
            if len(doc):
                has = np.flatnonzero(size)
                begin = np.searchsorted(doc, has)
                for i in range(TOKENS):
                    sketch[has, i] = np.minimum.reduceat((value * _MULTIPLY[i] + _ADD[i]) >> _U(32), begin).astype("<u4")
            raw, at = value.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(size)]) * 4
            sets = [raw[at[i]:at[i + 1]] for i in range(n)]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(size, pa.int32()),
                pa.array([hashlib.blake2b(s, digest_size=16).digest() if s else None for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sketch], pa.binary()), pa.array(sets, pa.binary())],
                names=["doc_id", "size", "digest", "sketch", "shingles"])


def _positions(path: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions that the nodes named by ``path`` sample."""
    draw = mix(path + _U(1))
    one = (draw % _U(TOKENS)).astype(np.int64)
    step = 1 + (mix(path + _U(2)) % _U(TOKENS - 1)).astype(np.int64)
    extra = (mix(path + _U(3)) >> _U(11)).astype(np.float64) / (1 << 53) < 1 / threshold - 1
    rows = np.arange(len(path))
    return np.concatenate([rows, rows[extra]]), np.concatenate([one, (one + step)[extra] % TOKENS])


def _children(path: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    rows, position = _positions(path, threshold)
    token = (position.astype(_U) << _U(32)) | sketch[rows, position].astype(_U)
    return rows, mix(path[rows] ^ mix(token + _U(7)))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, TOKENS)


def _descend(runs: int | None, threshold: float):
    """(rep, sketch) to the children of all runs' roots, or (path, rep, sketch) to the children of path."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, sketch = batch.column(0).to_numpy(), _sketches(batch.column(1))
            for run in range(runs):
                root, picked = _root(run, threshold)
                for position in picked:
                    token = (_U(position) << _U(32)) | sketch[:, position].astype(_U)
                    path = mix(root ^ mix(token + _U(7)))
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(rep)], names=["path", "rep"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, rep = batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy()
            rows, child = _children(path, _sketches(batch.column(2)), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(rep[rows])], names=["path", "rep"])

    return roots if runs else below


def _leaves(reps: DataFrame, scratch: Scratch, runs: int, threshold: float, bucket: int, depth: int) -> DataFrame:
    """Stored (path, rep, blocks): the sets of every leaf that holds two or more."""
    level = reps.select("rep", "sketch").mapInArrow(_descend(runs, threshold), "path long, rep long")
    out, stored = None, []
    for d in range(1, depth + 1):
        rows = scratch.store(level)
        # Stored before the join, so that both sides are dealt anew and the rows of one hot
        # node (a large group of near copies) can be split over tasks.
        counts = scratch.store(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        sized = scratch.store(rows.join(counts, "path"))
        scratch.drop(rows, counts)
        stored.append(sized)
        limit = F.lit(bucket if d < depth else 1 << 62)
        leaf = sized.where(F.col("n") <= limit).select("path", "rep", F.ceil(F.col("n") / bucket).cast("int").alias("blocks"))
        out = leaf if out is None else out.union(leaf)
        big = sized.where(F.col("n") > limit).select("path", "rep")
        if d == depth or big.isEmpty():
            break
        level = (big.join(reps.select("rep", "sketch"), "rep").select("path", "rep", "sketch")
                 .mapInArrow(_descend(None, threshold), "path long, rep long"))
    leaves = scratch.store(out)
    scratch.drop(*stored)
    return leaves


def runs_of_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in last])
        start = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
        if start:
            held.append(batch.slice(0, start))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        elif held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, last)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs i < j of one group each, some groups at a time: all pairs of a block with
    itself (side 2), those across two blocks else."""
    n = len(group)
    ends = np.searchsorted(group, group, side="right")
    after = ends - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, side="right")) - 1)
        i = np.repeat(np.arange(at, to), after[at:to])
        j = np.arange(len(i)) - (total[i] - total[at]) + i + 1
        keep = (side[i] == 2) | (side[i] != side[j])
        yield i[keep], j[keep]
        at = to


def _first_met(path: np.ndarray, group: np.ndarray, lists: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs' leaf is the least leaf that both sets are in."""
    flat, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    flat, offs = flat[:offs[-1] - offs[0]], offs - offs[0]
    out = np.ones(len(i), bool)
    many = np.bincount(group[i], minlength=int(group[-1]) + 1)
    for g in np.flatnonzero(many > DENSE):
        # One product of membership rows for a group with many pairs.
        own = np.flatnonzero(group == g)
        lo, hi = own[0], own[-1] + 1
        leaf, row = flat[offs[lo]:offs[hi]], np.repeat(np.arange(hi - lo), np.diff(offs[lo:hi + 1]))
        less = leaf < path[lo]
        known, column = np.unique(leaf[less], return_inverse=True)
        member = np.zeros((hi - lo, max(1, len(known))), np.float32)
        member[row[less], column] = 1
        here = np.flatnonzero(group[i] == g)
        out[here] = (member @ member.T)[i[here] - lo, j[here] - lo] == 0
    few = np.flatnonzero(many[group[i]] <= DENSE)
    if len(few):
        width = int(np.diff(offs).max())
        for at in range(0, len(few), 1 << 14):
            part = few[at:at + (1 << 14)]
            padded = []
            for rows, filler in ((i[part], -1), (j[part], -2)):
                take = offs[rows][:, None] + np.arange(width)
                inside = take < offs[rows + 1][:, None]
                leaf = flat[np.minimum(take, len(flat) - 1)]
                low = inside & (leaf < path[rows][:, None])
                padded.append((leaf, low))
            (x, a), (y, b) = padded
            out[part] = ~((x[:, :, None] == y[:, None, :]) & a[:, :, None] & b[:, None, :]).any((1, 2))
    return out


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    columns = [table[k].to_numpy() for k in keys]
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate([[0], np.cumsum(new)])


def _compared(table: pa.Table, group: np.ndarray, threshold: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sketches could reach the threshold and that are counted in their leaf."""
    least = least_shared(threshold, recall)
    size, side, path = (table[c].to_numpy() for c in ("size", "side", "path"))
    low = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(-1, TOKENS)
    lists = table["leaves"].combine_chunks()
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _pairs(group, side):
        keep = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[keep], j[keep]
        near = (low[i] == low[j]).sum(1) >= least
        i, j = i[near], j[near]
        if len(i):
            here = _first_met(path, group, lists, i, j)
            found_i.append(i[here])
            found_j.append(j[here])
    return np.concatenate(found_i), np.concatenate(found_j)


def _candidates(threshold: float, recall: float):
    """Sets of a leaf that have a pair to verify in it."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of_groups(batches, TILE):
            i, j = _compared(table, _groups(table, TILE), threshold, recall)
            hit = np.zeros(table.num_rows, bool)
            hit[i] = hit[j] = True
            yield from table.select([*TILE, "side", "rep", "leaves"]).filter(pa.array(hit)).to_batches()

    return tasks


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sorted sets: by an indicator product over
    the tokens that at least two of the sets hold, a slice of tokens at a time."""
    out = np.zeros(len(i), np.int64)
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[:len(i)], at[len(i):]
    if len(i) * 4 < len(used) ** 2:
        for k in range(len(i)):
            x, y = sets[i[k]], sets[j[k]]
            where = np.searchsorted(y, x)
            out[k] = np.count_nonzero(y[np.minimum(where, len(y) - 1)] == x)
        return out
    flat = np.concatenate([sets[u] for u in used])
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    token, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    product = np.zeros((len(used), len(used)), np.float32)
    for start in range(0, int(shared.sum()), 8192):
        lo, hi = np.searchsorted(column, [start, start + 8192])
        m = np.zeros((len(used), 8192), np.float32)
        m[row[lo:hi], column[lo:hi] - start] = 1
        product += m @ m.T
    return product[a, b].astype(np.int64)


def _verify(threshold: float, recall: float):
    """Links and least local id of every set that has a link counted in this leaf."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of_groups(batches, TILE):
            # Repeated rows of a document have brought its set twice.
            again = _groups(table, [*TILE, "rep"])
            table = table.take(pa.array(np.flatnonzero(np.diff(again, prepend=-1))))
            group = _groups(table, TILE)
            i, j = _compared(table, group, threshold, recall)
            size, copies, rep = (table[c].to_numpy() for c in ("size", "copies", "rep"))
            sets = [np.frombuffer(s.as_buffer(), "<u4") for s in table["shingles"]]
            both = np.zeros(len(i), np.int64)
            edge = np.flatnonzero(np.diff(group[i], prepend=-1, append=-1)) if len(i) else []
            for lo, hi in zip(edge[:-1], edge[1:]):
                both[lo:hi] = overlaps(sets, i[lo:hi], j[lo:hi])
            link = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[link], j[link]
            links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
            root = rep[least_labels(len(rep), i, j)]
            has = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[has]), pa.array(links[has].astype(np.int64)), pa.array(root[has])],
                                             names=["rep", "links", "root"])

    return tasks


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET, depth: int = DEPTH,
                    recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id reachable over links), n_links (other documents
    linked directly) and kept (the class's own id) for every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    runs = runs_needed(threshold, depth, recall)
    sets = scratch.store(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
                         .mapInArrow(_sets, "doc_id long, size int, digest binary, sketch binary, shingles binary"))
    some = sets.where("digest is not null")
    members = some.select("doc_id", "digest").distinct()
    counts = members.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"))
    # Each set under the least doc_id of its copies, whose row also holds its shingles.
    reps = scratch.store(some.groupBy("doc_id", "digest").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
                         .join(counts.withColumnRenamed("rep", "doc_id"), ["doc_id", "digest"])
                         .withColumn("rep", F.xxhash64("digest")))
    leaves = _leaves(reps, scratch, runs, threshold, bucket, depth)
    lists = leaves.groupBy("rep").agg(F.collect_set("path").alias("leaves"))
    own = F.pmod(F.xxhash64("rep", "path"), F.col("blocks")).cast("int")
    dealt = (leaves.join(lists, "rep").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("path", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                     F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
                     "rep", "leaves"))
    # One byte a token is enough to find candidates.
    small = scratch.store(reps.select("rep", "doc_id", "size", "copies", "sketch")
                          .mapInArrow(_low_bytes, "rep long, doc_id long, size int, copies long, bits binary"))
    rows = "path long, low int, high int, side int, rep long, leaves array<bigint>"
    asked = scratch.store(dealt.join(small.select("rep", "size", "bits"), "rep").repartition(*TILE).sortWithinPartitions(*TILE)
                          .mapInArrow(_candidates(threshold, recall), rows))
    scratch.drop(leaves)
    whole = some.select("doc_id", F.xxhash64("digest").alias("rep"), "shingles")
    found = scratch.store(asked.join(small, "rep").join(whole, ["doc_id", "rep"]).drop("doc_id")
                          .repartition(*TILE).sortWithinPartitions(*TILE, "rep")
                          .mapInArrow(_verify(threshold, recall), "rep long, links long, root long"))
    scratch.drop(asked, small)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    ids = reps.select("rep", "doc_id")
    edges = (found.where("rep <> root").join(ids, "rep").select(F.col("doc_id").alias("a"), F.col("root").alias("rep"))
             .join(ids, "rep").select("a", F.col("doc_id").alias("b")))
    components = least_reachable(edges)
    known = (reps.select("digest", "rep", "doc_id", "copies").join(links, "rep", "left")
             .join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left")
             .select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "doc_id").alias("class_id")))
    linked = members.join(known, "digest").select("doc_id", "class_id", "n_links")
    zero = F.lit(0).cast("long")
    alone = sets.where("digest is null").select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"))
    nameless = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("class_id"), zero.alias("n_links"))
    out = linked.union(alone).union(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    out.reads = (sets, reps, found)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class: of each class the least doc_id, and
    of rows that share it the first by text.  Rows with a null doc_id all stay."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    found = near_duplicates(docs)
    ids = scratch.store(found.where("kept").select(F.col("doc_id").alias("_id")).distinct())
    scratch.drop(*found.reads)
    same = W.partitionBy("doc_id").orderBy("text")
    named = (docs.where("doc_id is not null").join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
             .withColumn("_row", F.row_number().over(same)).where("_row = 1").drop("_row"))
    return named.union(docs.where("doc_id is null"))


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = (_sketches(batch.column(4)) >> 24).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([b.tobytes() for b in bits], pa.binary())],
                                         names=[*batch.schema.names[:4], "bits"])
