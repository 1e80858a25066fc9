"""Removal of repeated passages by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed.
A window is such a string at one place.  Windows that can be equal must share a shard, so
each window goes by its anchor, the least hashed gram of ``GRAM`` bytes inside it: equal
windows have equal anchors.  Only anchors that occur again matter; the windows of one anchor
place, with the bytes they cover, are its context (some 270 bytes).

1. Texts are stored once, bucketed by row, so that later joins move no text.
2. Anchors of all texts are counted; contexts of those that occur again get a digest, and
   equal contexts become one with its number of copies.
3. Contexts sorted by anchor form shards of about ``SHARD_BYTES``.  Each shard gets a suffix
   array by Larsson-Sadakane refinement and common prefixes by Kasai's pass: runs of suffixes
   with ``LENGTH`` bytes in common that hold two windows, or one of two copies, repeat.
4. An anchor of more than ``GROUP_CONTEXTS`` contexts is dealt over several shards.  Their
   windows become sorted runs of digests, cut into ranges, and each range of all shards is
   merged by binary search; equal neighbours repeat.
5. Repeated windows go back to the rows that hold their context.

Defined results: a null text is empty; texts shorter than ``LENGTH`` bytes stay whole; repeated
rows are texts of their own, so longer ones go entirely; a null doc_id is kept; an empty table
gives no rows; only doc_id and text are read.  Digests have 128 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.llm.arrowtext import mix
from skewline.llm.common import Scratch
from skewline.session import shared_path

LENGTH = 200
GRAM = 64
SHARD_BYTES = 1 << 20
GROUP_CONTEXTS = 2048
BUCKET_BYTES, MAX_BUCKETS = 32 << 20, 100_000
CONTAINER = 1024  # windows of one context at most
_SLICE = 1 << 20
_PLACE = 22  # bits of a place in a slice
_U = np.uint64


# Texts and anchors

def store_texts(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """row, doc_id and the text's bytes, bucketed and sorted by row."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = docs.select(F.octet_length(F.col("text").cast("string")).alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes)))
    name, path = f"skewline_texts_{uuid.uuid4().hex}", shared_path(spark, "llm-texts")
    (docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
     .repartition(buckets, "row").write.format("parquet").option("path", path).option("compression", "zstd")
     .bucketBy(buckets, "row").sortBy("row").saveAsTable(name))
    texts = spark.table(name)
    texts.schema  # resolved: the scan outlives the name
    texts.stored_as = name
    return texts


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two, 8 or more) at each place."""
    h = mix(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(_U)[:, 0])
    size = 8
    while size < gram:
        h = mix(h[:-size] * _U(0xD6E8FEB86659FD93) + h[size:])
        size *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in the texts ``data[offsets[k]:offsets[k + 1]]``, each of
    ``length`` bytes or more: anchor, first window, windows, and whether the anchor has several places."""
    h = gram_hashes(data, gram)
    place = np.arange(len(h), dtype=_U)
    # Least by hash, then leftmost: it depends on the window's bytes alone.
    least = sliding_min((h >> _U(_PLACE) << _U(_PLACE)) | place, length - gram + 1) & _U((1 << _PLACE) - 1)
    first, last = offsets[:-1], offsets[1:] - length + 1
    windows = np.zeros(len(data) + 1, np.int8)
    windows[first] = 1
    windows[last] = -1
    inside = np.cumsum(windows[:len(least)]).astype(bool)
    at = h[least.astype(np.int64)]
    new_place, new_gram = np.ones(len(least), bool), np.ones(len(least), bool)
    new_place[1:] = least[1:] != least[:-1]
    new_gram[1:] = at[1:] != at[:-1]
    new_gram[first] = new_place[first] = True
    # Long runs (periodic text) are cut every CONTAINER windows.
    group = np.flatnonzero(new_gram)
    since = np.arange(len(least)) - np.repeat(group, np.diff(np.append(group, len(least))))
    start = np.flatnonzero((new_gram | (since % CONTAINER == 0)) & inside)
    end = np.minimum(np.append(start[1:], len(data)), last[np.searchsorted(offsets, start, side="right") - 1])
    places = np.concatenate([[0], np.cumsum(new_place)])
    several = places[end] - places[np.minimum(start + 1, end)] > 0
    return at[start], start, end - start, several


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Rows, their offsets in their texts, bytes and offsets of slices of about ``_SLICE`` bytes;
    a longer text comes in pieces that overlap by ``length - 1`` bytes."""
    rows, bases, parts, size = [], [], [], 0

    def cut():
        offsets = np.cumsum([0, *map(len, parts)])
        return rows, bases, np.frombuffer(b"".join(parts), np.uint8), offsets

    for batch in batches:
        for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = memoryview(value.as_buffer())
            for at in range(0, max(0, len(data) - length + 1), _SLICE):
                part = data[at:at + _SLICE + length - 1]
                rows.append(row), bases.append(at), parts.append(part)
                size += len(part)
                if size >= _SLICE:
                    yield cut()
                    rows, bases, parts, size = [], [], [], 0
    if parts:
        yield cut()


def anchor_table(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """g, row, start, len and several of every run of windows with one anchor."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bases, data, offsets in pieces(batches, length):
            g, start, size, several = anchors(data, offsets, length, gram)
            text = np.searchsorted(offsets, start, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(np.array(rows, np.int64)[text]),
                 pa.array((start - offsets[text] + np.array(bases)[text]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(several)],
                names=["g", "row", "start", "len", "several"])

    return texts.select("row", "data").mapInArrow(tasks, "g long, row long, start int, len int, several boolean")


# Contexts

def structs(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Offsets and flat fields of a column of lists of structs."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return offsets - offsets[0], {f.name: flat.field(k) for k, f in enumerate(flat.type)}


def with_texts(texts: DataFrame, rows: DataFrame, *fields: str) -> DataFrame:
    """row, data and ``at``, the list of the ``fields`` of each row of ``rows``: only ``rows`` is shuffled."""
    lists = rows.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("at"))
    return texts.join(lists, "row").select("row", "data", "at")


def context_digests(texts: DataFrame, occurrences: DataFrame, length: int) -> DataFrame:
    """c (digest of the context), g, row, start and len of every occurrence."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, at = structs(batch.column(2))
            start, size = at["start"].to_pylist(), at["len"].to_pylist()
            digests = []
            for k, value in enumerate(batch.column(1)):
                data = memoryview(value.as_buffer())
                digests += [hashlib.blake2b(data[start[j]:start[j] + size[j] + length - 1], digest_size=16).digest()
                            for j in range(offsets[k], offsets[k + 1])]
            row = batch.column(0).take(pa.array(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), at["g"], row, at["start"], at["len"]],
                                             names=["c", "g", "row", "start", "len"])

    return with_texts(texts, occurrences, "g", "start", "len").mapInArrow(tasks, "c binary, g long, row long, start int, len int")


def context_bytes(texts: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """c, g, part, parts, copies and the bytes of the chosen contexts."""
    names = ["c", "g", "part", "parts", "copies"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, at = structs(batch.column(2))
            start, size = at["start"].to_pylist(), at["len"].to_pylist()
            data = []
            for k, value in enumerate(batch.column(1)):
                text = memoryview(value.as_buffer())
                data += [bytes(text[start[j]:start[j] + size[j] + length - 1]) for j in range(offsets[k], offsets[k + 1])]
            yield pa.RecordBatch.from_arrays([*(at[c] for c in names), pa.array(data, pa.binary())], names=[*names, "data"])

    return (with_texts(texts, chosen, *names, "start", "len")
            .mapInArrow(tasks, "c binary, g long, part int, parts int, copies long, data binary"))


# Suffix arrays

def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson-Sadakane refinement: suffixes start in groups of seven
    equal bytes; in each round every group of two or more is sorted by the groups h bytes on."""
    n = len(data)
    padded = np.concatenate([data.astype(_U) + _U(1), np.zeros(7, _U)])
    key = np.zeros(n, _U)
    for k in range(7):
        key = key * _U(257) + padded[k:k + n]
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    place = np.arange(n)
    h = 7
    while True:
        # ``place`` are the positions in the array that this round sorted, ``new`` the first of each group.
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(place)))
        group = np.repeat(place[first], size)
        rank[sa[place]] = group
        open_ = np.repeat(size > 1, size)
        place, group = place[open_], group[open_]
        if not len(place):
            return sa, rank
        at = sa[place]
        after = np.append(rank, -1)[np.minimum(at + h, n)]
        key = group * (n + 1) + after + 1
        order = np.argsort(key)
        key = key[order]
        sa[place] = at[order]
        new = np.ones(len(place), bool)
        new[1:] = key[1:] != key[:-1]
        h *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, rank: np.ndarray, cap: int, lane: int = 256) -> np.ndarray:
    """Bytes, up to ``cap``, that the suffix at each place of the array shares with the one before.
    Kasai's pass: along the text the shared length drops by one at most, so it is carried on;
    stretches of ``lane`` suffixes advance side by side."""
    n = len(data)
    text = np.append(data.astype(np.int16), np.int16(-1))
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    i = np.arange(0, n, lane)
    stop = np.minimum(i + lane, n)
    h = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        more = (j >= 0) & (h < cap) & (text[i + h] == text[np.maximum(j + h, 0)])
        h += more
        done = np.flatnonzero(~more)
        at = i[done]
        out[rank[at]] = h[done]
        i[done] = at + 1
        h[done] = np.where(j[done] >= 0, np.maximum(h[done] - 1, 0), 0)
        if (at + 1 == stop[done]).any():
            left = i < stop
            i, stop, h = i[left], stop[left], h[left]
    return out


def repeated_windows(contexts: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of a shard: (places that repeat as a mask over the shard's bytes, places of
    one window of each distinct string, starts of the contexts, the shard's bytes)."""
    offsets = np.cumsum([0, *map(len, contexts)])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    valid = np.zeros(len(data) + 1, np.int8)
    valid[offsets[:-1]] = 1
    valid[offsets[1:] - length + 1] = -1
    valid = np.cumsum(valid[:-1]).astype(bool)
    sa, rank = suffix_array(data)
    run = np.cumsum(common_prefixes(data, sa, rank, length) < length)
    keep = valid[sa]
    at, run = sa[keep], run[keep]
    _, first, run = np.unique(run, return_index=True, return_inverse=True)
    total = np.bincount(run, copies[np.searchsorted(offsets, at, side="right") - 1])
    repeats = np.zeros(len(data), bool)
    repeats[at[total[run] >= 2]] = True
    return repeats, at[first], offsets[:-1], data


def intervals(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first and end window (from the context's start) of every run of ``mask``."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    context = np.searchsorted(starts, a, side="right") - 1
    return context, a - starts[context], b - starts[context]


def span_rows(c: list[bytes], context: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[bytes], pa.Array]:
    """One list (a, b, a, b, ...) a context."""
    which, first = np.unique(context, return_index=True)
    offsets = 2 * np.append(first, len(context))
    flat = np.stack([a, b], 1).ravel().astype(np.int32)
    return [c[k] for k in which.tolist()], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


_ENTRY = np.dtype([("window", "S16"), ("c", "S16"), ("x", "<i4")])
_FOUND = pa.schema([("c", pa.binary()), ("spans", pa.list_(pa.int32())), ("g", pa.int64()), ("part", pa.int32()), ("range", pa.int32()),
                    ("windows", pa.binary())])


def found_batch(c=None, spans=None, runs=None) -> pa.RecordBatch:
    """Rows of contexts with their repeated windows, or of runs (g, part, range, entries)."""
    if runs is None:
        nothing = [pa.nulls(len(c), f.type) for f in _FOUND][2:]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), spans, *nothing], schema=_FOUND)
    columns = [pa.array(x, f.type) for x, f in zip(zip(*runs), list(_FOUND)[2:])]
    return pa.RecordBatch.from_arrays([pa.nulls(len(runs), f.type) for f in list(_FOUND)[:2]] + columns, schema=_FOUND)


def window_runs(group: list[tuple], repeats: np.ndarray, distinct: np.ndarray, starts: np.ndarray, data: np.ndarray, length: int) -> list[tuple]:
    """Sorted runs of window digests of the contexts whose anchor lies in several shards; an entry
    names its window's context unless the window is known to repeat."""
    out = []
    context = np.searchsorted(starts, distinct, side="right") - 1
    chosen: dict[tuple, list] = {}
    raw = data.tobytes()
    for p, k in zip(distinct.tolist(), context.tolist()):
        _, g, part, parts, _, _ = group[k]
        if parts > 1:
            digest = hashlib.blake2b(raw[p:p + length], digest_size=16).digest()
            cut = int.from_bytes(digest[:4], "big") * parts >> 32
            owner = (b"", -1) if repeats[p] else (group[k][0], p - int(starts[k]))
            chosen.setdefault((g, part, cut), []).append((digest, *owner))
    for key, entries in chosen.items():
        run = np.array(entries, _ENTRY)
        out.append((*key, run[np.argsort(run["window"])].tobytes()))
    return out


def find_in_shards(contexts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Repeated windows of the contexts of each shard, and runs of window digests of split anchors.
    ``contexts`` is sorted by (g, part) within partitions."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def shard() -> Iterator[pa.RecordBatch]:
            repeats, distinct, starts, data = repeated_windows([r[5] for r in group], np.array([r[4] for r in group]), length)
            context, a, b = intervals(repeats, starts)
            if len(a):
                yield found_batch(*span_rows([r[0] for r in group], context, a, b))
            runs = window_runs(group, repeats, distinct, starts, data, length) if any(r[3] > 1 for r in group) else []
            if runs:
                yield found_batch(runs=runs)

        size, last = 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= shard_bytes and r[1:3] != last:
                    yield from shard()
                    group, size = [], 0
                group.append(r)
                size, last = size + len(r[5]), r[1:3]
        if group:
            yield from shard()

    return contexts.select("c", "g", "part", "parts", "copies", "data").mapInArrow(
        tasks, "c binary, spans array<int>, g long, part int, range int, windows binary")


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Merge sorted runs two by two: each entry's place is its own plus the binary search in the other run."""
    while len(runs) > 1:
        merged = []
        for a, b in zip(runs[::2], runs[1::2]):
            out = np.empty(len(a) + len(b), _ENTRY)
            out[np.arange(len(a)) + np.searchsorted(b["window"], a["window"], side="left")] = a
            out[np.arange(len(b)) + np.searchsorted(a["window"], b["window"], side="right")] = b
            merged.append(out)
        runs = merged + runs[len(merged) * 2:]
    return runs[0]


def merge_shards(found: DataFrame) -> DataFrame:
    """c and spans of windows that repeat in several shards of one anchor."""
    def group(rows: pa.Table) -> pa.Table:
        merged = merge_runs([np.frombuffer(w, _ENTRY) for w in rows["windows"].to_pylist()])
        same = merged["window"][1:] == merged["window"][:-1]
        hit = np.zeros(len(merged), bool)
        hit[1:] |= same
        hit[:-1] |= same
        owners = np.sort(merged[hit & (merged["x"] >= 0)], order=["c", "x"])
        names, context = np.unique(owners["c"], return_inverse=True)
        c, spans = span_rows([x.ljust(16, b"\0") for x in names.tolist()], context, owners["x"], owners["x"] + 1)
        return pa.table({"c": pa.array(c, pa.binary()), "spans": spans if c else pa.array([], pa.list_(pa.int32()))})

    return found.where(F.col("windows").isNotNull()).groupBy("g", "range").applyInArrow(group, "c binary, spans array<int>")


# Removal

def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                   group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, as start and end) and kept (the remaining bytes)
    of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    texts = store_texts(docs)
    table = scratch.store(anchor_table(texts, length, gram))
    again = (table.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("several"))
             .where("n > 1 or several").select("g"))
    occurrences = scratch.store(context_digests(texts, table.join(again, "g", "left_semi"), length))
    distinct = scratch.store(occurrences.groupBy("c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start", "len", "g")).alias("at"))
                             .select("c", "copies", "at.*"))
    split = (distinct.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_contexts)
             .select("g", F.ceil(F.col("n") / group_contexts).cast("int").alias("parts")))
    chosen = (distinct.join(split, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
              .withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")))
    size = distinct.agg(F.sum(F.col("len") + length - 1)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * shard_bytes)))
    shards = context_bytes(texts, chosen, length).repartition(tasks, "g", "part").sortWithinPartitions("g", "part")
    found = scratch.store(find_in_shards(shards, length, shard_bytes))
    verdicts = found.where(F.col("c").isNotNull()).select("c", "spans").union(merge_shards(found))
    marks = scratch.store(occurrences.join(verdicts, "c").groupBy("row").agg(F.collect_list(F.struct("start", "spans")).alias("at")))
    scratch.drop(table, occurrences, distinct, found)
    out = removed(texts.join(marks, "row", "left").select("doc_id", "data", "at"), length)
    spark.sql(f"DROP TABLE {texts.stored_as}")
    return out


def removed(marked: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, spans and kept from the texts and their repeated windows."""
    kinds = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, spans, kept = [], [], []
            for value, at in zip(batch.column(1), batch.column(2)):
                data = value.as_py()
                cuts: list[dict] = []
                if at.is_valid:
                    starts, windows = at.values.field(0).to_numpy(), at.values.field(1)
                    counts = np.diff(windows.offsets.to_numpy())
                    flat = windows.flatten().to_numpy().reshape(-1, 2) + np.repeat(starts, counts // 2)[:, None]
                    a, b = flat[np.argsort(flat[:, 0], kind="stable")].T
                    end = np.maximum.accumulate(b + length - 1)
                    gap = np.flatnonzero(a[1:] > end[:-1])
                    cuts = [{"start": s, "end": e} for s, e in zip(a[np.append(0, gap + 1)].tolist(), end[np.append(gap, len(end) - 1)].tolist())]
                edges = [0, *(x for c in cuts for x in (c["start"], c["end"])), len(data)]
                size.append(len(data)), spans.append(cuts)
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(kinds)), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "spans", "kept"])

    return marked.mapInArrow(tasks, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
