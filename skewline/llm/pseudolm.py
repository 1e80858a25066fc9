"""Masked pseudo-likelihood scores of documents.

A small network predicts every word from the two words on either side: the four neighbours'
vectors, one hidden tanh layer, and a two-level softmax (a group of words, then the word in
the group).  A document's score is the sum of log p(word | both sides) over all its words.

The vocabulary grows with the corpus, by word counts over all documents (by Spark).  With N words
of text, every word met sqrt(N) / ``NET_ROOT`` times (and the ``LEAST_VOCABULARY`` most frequent ones
at least) has an output of its own, in about sqrt(V) groups of sqrt(V) words.  Words met
sqrt(N) / ``COUNT_ROOT`` times (twice at least) fall into ``OTHER`` hash classes and are charged
log p(class | sides) + log p(word | class), the latter from their counts.  All others fall into one
more class and are charged log p(class | sides) + log p(spelling), from pairs of neighbouring
bytes in such words: so every string has a probability of its own, and they sum to at most 1.

The network starts from a fit to a bounded sample (about ``WARM_WINDOWS`` pieces of ``WARM_CHARS``
characters from all places of all texts); then every trainer goes on, with the step sizes reached
there, over all its documents, and the trainers' weights are averaged, weighted by their words, in
blocks of ``BLOCK`` parameters in two Spark aggregates.  There are at most sqrt(N) / ``TRAINER_ROOT``
trainers (``LEAST_TRAINERS`` at least), and parameters grow with sqrt(N) too, so what is gathered
grows in proportion to the input, while the driver sees each parameter once.

Defined results: words are lower-case runs of letters, digits and non-ASCII characters;
a null text is empty; a text without words has 0 words, log_prob 0 and a null mean; repeated
rows are trained on and scored as separate documents, as are rows with a null doc_id; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.llm.arrowtext import byte_slices, mix, text_bytes, word_hashes, words
from skewline.llm.common import Scratch, draw_windows

LEAST_VOCABULARY = 960
NET_ROOT, COUNT_ROOT = 3, 500
OTHER = 64
WIDTH = 16
SIDES = (-2, -1, 1, 2)
BATCH = 8192
WARM_WINDOWS, WARM_CHARS, WARM_EPOCHS = 500, 4000, 6
TRAINER_ROOT, LEAST_TRAINERS = 100, 64
BLOCK = 4096
WARM_RATE, RATE = 0.1, 0.05
_U = np.uint64
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[48:58] = _SEPARATORS[65:91] = _SEPARATORS[97:123] = _SEPARATORS[128:] = False

PARTS = ("embed", "hidden", "hidden_bias", "group", "group_bias", "word", "word_bias")


class Words(NamedTuple):
    """What is known of the corpus' words."""

    known: np.ndarray  # sorted hashes of the words met often enough
    ids: np.ndarray  # their classes
    inside: np.ndarray  # their log p(word | class)
    spelling: np.ndarray  # log p(byte | byte before) at 256 * before + byte; 0 is a word's border
    share: np.ndarray  # share of every class in the corpus; unused ones fill up the last group
    spelled: int  # the class of all other words
    size: int  # classes a group
    total: int  # words of the corpus
    start: np.ndarray | None = None  # see ``bucket_starts``


def bucket_starts(known: np.ndarray) -> np.ndarray:
    """Where the sorted hashes with each of the leading bits begin, about two buckets a hash."""
    bits = len(known).bit_length() + 1
    return np.searchsorted(known, np.arange(1 << bits, dtype=_U) << _U(64 - bits)).astype(np.int32)


def find_hashes(known: np.ndarray, start: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in ``known``, -1 if it is not there: its bucket's hashes one after another."""
    out = np.full(len(h), -1)
    if not len(known):
        return out
    left = np.arange(len(h))
    at = start[(h >> _U(64 - (len(start).bit_length() - 1))).astype(np.int64)].astype(np.int64)
    while len(left):
        near, own = known[np.minimum(at, len(known) - 1)], h[left]
        same = (near == own) & (at < len(known))
        out[left[same]] = at[same]
        on = (near < own) & (at < len(known) - 1)
        left, at = left[on], at[on] + 1
    return out


def shapes(n: int, size: int) -> dict[str, tuple[int, ...]]:
    """Shapes of the parameters for ``n`` classes; one more input is for places beyond a text's ends."""
    groups = n // size
    return dict(zip(PARTS, ((n + 1, WIDTH), (len(SIDES) * WIDTH, WIDTH), (WIDTH,), (WIDTH, groups), (groups,), (groups, WIDTH, size), (groups, size))))


def new_network(share: np.ndarray, size: int, seed: int = 11) -> dict[str, np.ndarray]:
    """Small random weights; the biases give every class its ``share`` of the corpus."""
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.3, "hidden": 0.2, "group": 0.05, "word": 0.05}
    net = {k: (rng.normal(size=s) * scale.get(k, 0)).astype(np.float32) for k, s in shapes(len(share), size).items()}
    share = share.reshape(-1, size)
    net["group_bias"] = np.log(share.sum(1)).astype(np.float32)
    net["word_bias"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return net


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in PARTS])


def shaped(values: np.ndarray, n: int, size: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(n, size).items():
        count = int(np.prod(s))
        out[k] = values[at:at + count].astype(np.float32).reshape(s)
        at += count
    return out


def byte_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256 * (byte before) + byte at every byte (0 before a word), and at every word's end."""
    data = data.astype(np.int32)
    pair = data.copy()
    pair[1:] += data[:-1] << 8
    pair[starts] = data[starts]
    return pair, data[ends - 1] << 8


def classes(col: pa.Array, vocab: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every word of a string column, its log p(word | class), and the texts' borders."""
    if col.null_count:
        col = col.fill_null("")
    data, offs = text_bytes(pc.utf8_lower(col))
    starts, ends, first = words(data, offs, _SEPARATORS)
    h = word_hashes(data, starts, ends)
    at = find_hashes(vocab.known, bucket_starts(vocab.known) if vocab.start is None else vocab.start, h)
    hit = at >= 0
    out, inside = np.full(len(h), vocab.spelled), np.zeros(len(h))
    out[hit], inside[hit] = vocab.ids[at[hit]], vocab.inside[at[hit]]
    rest = np.flatnonzero(~hit)
    if len(rest):
        # Only the bytes of these words, one word after another.
        size = ends[rest] - starts[rest]
        begin = np.cumsum(size) - size
        spelled = data[np.repeat(starts[rest] - begin, size) + np.arange(int(size.sum()))]
        pair, close = byte_pairs(spelled, begin, begin + size)
        inside[rest] = np.add.reduceat(vocab.spelling[pair].astype(np.float64), begin) + vocab.spelling[close]
    return out, inside, first


def contexts(token: np.ndarray, first: np.ndarray, outside: int) -> np.ndarray:
    """Classes beside every word, ``outside`` beyond its text."""
    n = len(token)
    lo, hi = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    at = np.arange(n)[:, None] + np.array(SIDES)
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(inside, token[np.clip(at, 0, max(n - 1, 0))], outside) if n else np.zeros((0, len(SIDES)), np.int64)


def _softmax(x: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log-softmax at the picked column of each row, and all probabilities.  Logits are sums
    of WIDTH bounded terms, far from overflow; the clip only guards against divergence."""
    np.clip(x, -60, 60, out=x)
    at = x[np.arange(len(x)), picked]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    x /= total[:, None]
    return at - np.log(total), x


def log_probabilities(net: dict, token: np.ndarray, beside: np.ndarray, gradient: dict | None = None) -> np.ndarray:
    """log p(class | sides) of each word; with ``gradient`` also its summed gradient."""
    # Words of one group lie together, so each group is one matrix product.
    order = np.argsort(token, kind="stable")
    token, beside = token[order], beside[order]
    groups, size = net["word_bias"].shape
    group, inner = token // size, token % size
    border = np.searchsorted(group, np.arange(groups + 1))
    x = net["embed"][beside].reshape(len(token), -1)
    h = np.tanh(x @ net["hidden"] + net["hidden_bias"])
    rows = np.arange(len(token))
    logs, miss = _softmax(h @ net["group"] + net["group_bias"], group)
    if gradient is not None:
        miss = -miss
        miss[rows, group] += 1
        gradient["group"], gradient["group_bias"] = h.T @ miss, miss.sum(0)
        back = miss @ net["group"].T
        gradient["word"], gradient["word_bias"] = np.zeros_like(net["word"]), np.zeros_like(net["word_bias"])
    for g in range(groups):
        own = slice(border[g], border[g + 1])
        if border[g] == border[g + 1]:
            continue
        part, miss = _softmax(h[own] @ net["word"][g] + net["word_bias"][g], inner[own])
        logs[own] += part
        if gradient is not None:
            miss = -miss
            miss[np.arange(len(miss)), inner[own]] += 1
            gradient["word"][g], gradient["word_bias"][g] = h[own].T @ miss, miss.sum(0)
            back[own] += miss @ net["word"][g].T
    if gradient is not None:
        back *= 1 - h * h
        gradient["hidden"], gradient["hidden_bias"] = x.T @ back, back.sum(0)
        dx = np.ascontiguousarray((back @ net["hidden"].T).reshape(-1, WIDTH).T)
        at = beside.ravel()
        gradient["embed"] = np.stack([np.bincount(at, dx[i], len(net["embed"])) for i in range(WIDTH)], 1)
    out = np.empty(len(token))
    out[order] = logs
    return out


class Trainer:
    """Adagrad steps over batches of words; it keeps words that don't fill a batch yet.  ``sums``
    are the squared gradients so far."""

    def __init__(self, net: dict, rate: float, sums: dict | None = None):
        self.net, self.rate, self.words = {k: v.copy() for k, v in net.items()}, rate, 0
        self.sums = {k: np.full(v.shape, 1e-8, np.float32) if sums is None else sums[k].copy() for k, v in net.items()}
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.rng = np.random.default_rng(5)

    def add(self, token: np.ndarray, beside: np.ndarray, last: bool = False) -> None:
        self.waiting.append((token, beside))
        if not last and sum(len(t) for t, _ in self.waiting) < 8 * BATCH:
            return
        token, beside = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting = []
        order = self.rng.permutation(len(token))
        for at in range(0, len(order), BATCH):
            part, gradient = order[at:at + BATCH], {}
            log_probabilities(self.net, token[part], beside[part], gradient)
            for k, g in gradient.items():
                g = (g / len(part)).astype(np.float32)
                self.sums[k] += g * g
                self.net[k] += self.rate * g / np.sqrt(self.sums[k])
        self.words += len(token)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16)
    for batch in batches:
        for part in byte_slices(batch, "w"):
            data, offs = text_bytes(part.column(0))
            n = part.column(1).to_numpy()
            pair, close = byte_pairs(data, offs[:-1], offs[1:])
            total += np.bincount(pair, np.repeat(n, np.diff(offs)), 1 << 16) + np.bincount(close, n, 1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["pair", "n"])


def _spelling(rare: DataFrame) -> np.ndarray:
    """log p(byte | byte before) in words ``w`` met ``n`` times; one is added to each byte's count."""
    got = rare.mapInArrow(_pair_counts, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << 16)
    table[got["pair"].to_numpy()] = got["n"].to_numpy()
    table = table.reshape(256, 256)
    # Bytes of words, and the border, which can't follow itself.
    able = ~_SEPARATORS
    able[0] = True
    table[:, able] += 1
    table[0, 0] = 0
    table /= table.sum(1, keepdims=True)
    # Pairs that no word has are passed over by running sums across words.
    return np.log(np.where(table > 0, table, 1)).ravel().astype(np.float32)


def vocabulary(docs: DataFrame) -> Words:
    """The words of all documents: classes, counts and spelling."""
    scratch = Scratch(docs.sparkSession, "words")
    tokens = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z0-9\x{80}-\x{10FFFF}]+")).alias("w")).where("w <> ''")
    counts = scratch.store(tokens.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(2.0, total ** 0.5 / COUNT_ROOT)
    top = counts.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("w", "ascending")])
    spelling = _spelling(counts.where(F.col("n") < least))
    scratch.drop(counts)
    n = top["n"].to_numpy().astype(np.float64)
    own = min(len(n), max(LEAST_VOCABULARY, int((n >= total ** 0.5 / NET_ROOT).sum())))
    data, offs = text_bytes(top["w"].combine_chunks().cast(pa.string()))
    known = word_hashes(data, offs[:-1], offs[1:])
    ids = np.concatenate([np.arange(own), own + (mix(known[own:]) % _U(OTHER)).astype(np.int64)])
    spelled = own + OTHER
    size = int(np.ceil((spelled + 1) ** 0.5))
    share = np.full(-(-(spelled + 1) // size) * size, 1e-9)
    share[:spelled + 1] = 1
    share[:spelled] += np.bincount(ids, n, spelled)
    share[spelled] += total - n.sum()
    inside = np.zeros(len(n))
    inside[own:] = np.log(n[own:] / np.bincount(ids[own:], n[own:], spelled)[ids[own:]])
    order = np.argsort(known)
    return Words(known[order], ids[order], inside[order].astype(np.float32), spelling, share / share.sum(), spelled, size, total,
                 bucket_starts(known[order]))


def warm_start(docs: DataFrame, vocab: Words, warm_windows: int = WARM_WINDOWS) -> Trainer:
    """A start for all trainers: a fit to pieces of the texts."""
    got = draw_windows(docs.select(F.lit(0).alias("all"), "text"), warm_windows, WARM_CHARS, "all").toArrow().sort_by("window")
    token, _, first = classes(got["window"].combine_chunks().cast(pa.string()), vocab)
    trainer = Trainer(new_network(vocab.share, vocab.size), WARM_RATE)
    beside = contexts(token, first, len(vocab.share))
    for _ in range(WARM_EPOCHS if len(token) else 0):
        trainer.add(token, beside, last=True)
    return trainer


_SUMS = "block int, part int, words long, weighted binary"


def _add_blocks(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(w, "<f8") for w in rows["weighted"].to_pylist()], 0)
    return pa.table({"block": rows["block"][:1], "part": pa.array([0], pa.int32()), "words": [pc.sum(rows["words"])],
                     "weighted": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, start: Trainer, vocab: Words, rate: float = RATE) -> dict[str, np.ndarray]:
    """One pass over all documents: trainers go on from ``start``, their weights are averaged."""
    shared = docs.sparkSession.sparkContext.broadcast((flat(start.net), flat(start.sums), vocab))
    trainers = max(LEAST_TRAINERS, int(vocab.total ** 0.5 / TRAINER_ROOT))
    parts = int(np.ceil(trainers ** 0.5))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        values, sums, vocab = shared.value
        own = len(vocab.share), vocab.size
        trainer = Trainer(shaped(values, *own), rate, shaped(sums, *own))
        for batch in batches:
            for part in byte_slices(batch, "text"):
                token, _, first = classes(part.column(0), vocab)
                trainer.add(token, contexts(token, first, len(vocab.share)))
        trainer.add(np.zeros(0, np.int64), np.zeros((0, len(SIDES)), np.int64), last=True)
        if trainer.words:
            out = flat(trainer.net).astype("<f8") * trainer.words
            blocks = [out[a:a + BLOCK].tobytes() for a in range(0, len(out), BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId() % parts] * n, pa.int32()),
                 pa.array([trainer.words] * n, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "part", "words", "weighted"])

    rows = (docs.select("text").coalesce(trainers).mapInArrow(tasks, _SUMS)
            .groupBy("block", "part").applyInArrow(_add_blocks, _SUMS).groupBy("block").applyInArrow(_add_blocks, _SUMS))
    values = flat(start.net)
    for r in rows.select("block", "words", "weighted").toLocalIterator():
        block = np.frombuffer(r.weighted, "<f8") / r.words
        values[r.block * BLOCK:r.block * BLOCK + len(block)] = block
    return shaped(values, len(vocab.share), vocab.size)


def score(docs: DataFrame, warm_windows: int = WARM_WINDOWS) -> DataFrame:
    """doc_id, n_words, log_prob (summed) and mean_log_prob of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocab = vocabulary(docs)
    net = train(docs, warm_start(docs, vocab, warm_windows), vocab)
    shared = docs.sparkSession.sparkContext.broadcast((flat(net), vocab))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, vocab = shared.value
        own = shaped(values, len(vocab.share), vocab.size)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                token, inside, first = classes(part.column(1), vocab)
                beside = contexts(token, first, len(vocab.share))
                logs = inside + np.concatenate([np.zeros(0), *(log_probabilities(own, token[a:a + BATCH], beside[a:a + BATCH]) for a in range(0, len(token), BATCH))])
                total = np.concatenate([[0.0], np.cumsum(logs)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]])],
                                                 names=["doc_id", "n_words", "log_prob"])

    return (docs.mapInArrow(tasks, "doc_id long, n_words long, log_prob double")
            .withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))))
