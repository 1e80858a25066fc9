"""Language identification by a linear-chain conditional random field over words.

A word's score for each language is the mean learned weight of its affixes (n-grams of bytes
that touch a word border), its inner n-grams and the whole word, plus its log-odds in a
lexicon of the training words.  A learned matrix scores transitions, so words in
code-switched text take the language of their surroundings; forward-backward gives every
word's posterior, and a document's language is the one with the largest mean posterior.

Training takes about ``TRAIN_WINDOWS`` pieces of ``TRAIN_CHARS`` characters in all, equally many a
language and two at least (a documented bound), drawn from all places of all labelled texts, and joins
random segments of different languages into code-switched sequences, without which transitions
between languages could not be learned.  Every language present is learned; hash buckets of
features times languages stay within ``WEIGHTS`` (down to ``LEAST_FEATURES`` buckets), and the lexicon
holds the ``LEXICON_WORDS`` most frequent words of the pieces.  Prediction reads whole texts.

Forward-backward runs over all words of a batch at once: texts are cut into blocks, the
blocks' transfer matrices are multiplied along each text, and then all blocks run forwards
and backwards in parallel from exact border messages, so long texts cost no extra steps.

Defined results: ``und`` with score 0 if the text is null or has no letter, or nothing could be
learned; a null lang is never learned from; repeated rows are predicted alike; rows with a
null doc_id are predicted but neither held out nor learned from; an empty table gives no rows;
columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.llm.arrowtext import SLICE_BYTES, byte_slices, mix, text_bytes, word_hashes, words
from skewline.llm.common import draw_windows

FOLDS, HELD_OUT = 4, 2
TRAIN_WINDOWS, TRAIN_CHARS = 1200, 4000
FEATURES, LEAST_FEATURES, WEIGHTS = 1 << 15, 1 << 10, 1 << 22
ORDERS = (1, 2, 3, 4)
SEQUENCE, SEGMENT = 48, 16
EPOCHS, BATCH, RATE = 3, 64, 0.5
LEXICON_WORDS = 30_000
BLOCK = 32
UNKNOWN = "und"

_U = np.uint64
# Bytes that are no ASCII letter and below 128 separate words.
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[65:91] = _SEPARATORS[97:123] = _SEPARATORS[128:] = False


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


class Words:
    """Lower-case words of a string column: their texts, and features of the distinct ones."""

    def __init__(self, col: pa.Array):
        if col.null_count:
            col = col.fill_null("")
        data, offs = text_bytes(pc.utf8_lower(col))
        starts, ends, self.first = words(data, offs, _SEPARATORS)
        self.hashes, at, self.of_token = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        starts, length = starts[at], (ends - starts)[at]
        # Each distinct word between two spaces, one after another.
        self.begin = np.concatenate([[0], np.cumsum(length + 2)])
        self.bytes = np.full(self.begin[-1], 32, _U)
        word = np.repeat(np.arange(len(length)), length)
        inside = np.arange(len(word)) - (np.cumsum(length) - length)[word]
        self.bytes[self.begin[:-1][word] + 1 + inside] = data[starts[word] + inside]
        self.length = length + 2

    def features(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers below ``buckets`` and the distinct word of each, words in order."""
        index, owner = [(mix(self.hashes + _U(99)) % _U(buckets)).astype(np.int64)], [np.arange(len(self.hashes))]
        for n in ORDERS:
            count = np.maximum(self.length - n + 1, 0)
            word = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(word)) - (np.cumsum(count) - count)[word] + self.begin[:-1][word]
            code = np.full(len(at), n, _U)
            for i in range(n):
                code = code * _U(257) + self.bytes[at + i]
            index.append((mix(code) % _U(buckets)).astype(np.int64))
            owner.append(word)
        return np.concatenate(index), np.concatenate(owner)


def feature_buckets(languages: int) -> int:
    """A power of two: fewer buckets for more languages, so that the model stays bounded."""
    buckets = FEATURES
    while buckets > LEAST_FEATURES and buckets * languages > WEIGHTS:
        buckets //= 2
    return buckets


def emissions(w: Words, model: dict) -> np.ndarray:
    """Scores of every distinct word for every language."""
    n, k = len(w.hashes), len(model["langs"])
    index, owner = w.features(len(model["weights"]))
    out = np.zeros((n, k))
    count = np.bincount(owner, minlength=n)
    for c in range(k):
        out[:, c] = np.bincount(owner, model["weights"][index, c], n)
    out /= np.maximum(count, 1)[:, None]
    if len(model["lexicon"]):
        at = np.minimum(np.searchsorted(model["lexicon"], w.hashes), len(model["lexicon"]) - 1)
        known = model["lexicon"][at] == w.hashes
        out[known] += model["trust"][0] * model["odds"][at[known]]
    return out


def posteriors(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior of each language at every word; ``first`` has the words' text borders."""
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    e = np.exp(scores - scores.max(1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    size = np.diff(first)
    blocks = -(-size // block)
    doc = np.repeat(np.arange(len(size)), blocks)
    start_block = np.cumsum(blocks) - blocks
    number = np.arange(len(doc)) - start_block[doc]
    begin = first[:-1][doc] + number * block
    length = np.minimum(block, first[1:][doc] - begin)
    s = len(doc)
    # Transfer matrix of each block: the product of transition and emission over its words.
    m = np.broadcast_to(np.eye(k), (s, k, k)).copy()
    for i in range(int(length.max())):
        live = np.flatnonzero(length > i)
        p = (m[live].reshape(-1, k) @ t).reshape(-1, k, k) * e[begin[live] + i][:, None, :]
        m[live] = p / p.sum((1, 2), keepdims=True)
    # Messages at the borders of blocks, along each text.
    ahead, behind = np.full((s, k), 1 / k), np.full((s, k), 1 / k)
    for b in range(1, int(blocks.max()) if len(blocks) else 0):
        own = start_block[blocks > b] + b
        v = np.einsum("ij,ijk->ik", ahead[own - 1], m[own - 1])
        ahead[own] = v / v.sum(1, keepdims=True)
    for b in range(2, int(blocks.max()) + 1):
        own = (start_block + blocks - b)[blocks >= b]
        v = np.einsum("ijk,ik->ij", m[own + 1], behind[own + 1])
        behind[own] = v / v.sum(1, keepdims=True)
    out = np.empty((n, k))
    for i in range(int(length.max())):
        live = np.flatnonzero(length > i)
        v = ahead[live] @ t * e[begin[live] + i]
        ahead[live] = out[begin[live] + i] = v / v.sum(1, keepdims=True)
    for i in range(int(length.max()) - 1, -1, -1):
        live = np.flatnonzero(length > i)
        at = begin[live] + i
        out[at] *= behind[live]
        v = (behind[live] * e[at]) @ t.T
        behind[live] = v / v.sum(1, keepdims=True)
    return out / out.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> dict:
    """Fit weights, lexicon trust and transitions on code-switched sequences made from
    labelled texts, by stochastic gradient steps (Adagrad) on the conditional likelihood."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    k, buckets = len(names), feature_buckets(len(names))
    model = {"langs": names, "weights": np.zeros((buckets, k)), "lexicon": np.zeros(0, _U), "odds": np.zeros((0, k)),
             "trust": np.zeros(1), "transitions": np.zeros((k, k))}
    w = Words(pa.array(texts, pa.string()))
    label_of_doc = np.searchsorted(names, langs) if names else np.zeros(0, np.int64)
    label = np.repeat(label_of_doc, np.diff(w.first))
    if k < 2 or not len(label):
        return model
    seen = np.stack([np.bincount(w.of_token[label == c], minlength=len(w.hashes)) for c in range(k)], 1)
    often = np.sort(np.argsort(-seen.sum(1), kind="stable")[:LEXICON_WORDS])
    often = often[seen[often].sum(1) >= 3]
    odds = np.log((seen[often] + 0.3) / (seen.sum(0) + 1))
    model["lexicon"], model["odds"] = w.hashes[often], odds - odds.mean(1, keepdims=True)
    lexical = np.zeros((len(w.hashes), k))
    lexical[often] = model["odds"]
    index, owner = w.features(buckets)
    order = np.argsort(owner, kind="stable")
    index, border = index[order], np.searchsorted(owner[order], np.arange(len(w.hashes) + 1))
    share = 1 / np.maximum(np.diff(border), 1)
    # Segments of random length, in random order: neighbours often differ in language.
    cuts = np.flatnonzero(rng.random(len(label)) < 1 / SEGMENT)
    cuts = np.unique(np.concatenate([[0], w.first[:-1], cuts]))
    cuts = cuts[cuts < len(label)]
    pieces = np.split(np.arange(len(label)), cuts[1:])
    step_sums = {"weights": np.full((buckets, k), 1e-8), "trust": np.full(1, 1e-8), "transitions": np.full((k, k), 1e-8)}

    def step(name: str, gradient: np.ndarray, rate: float) -> None:
        step_sums[name] += gradient ** 2
        model[name] += rate * gradient / np.sqrt(step_sums[name])

    for _ in range(EPOCHS):
        rng.shuffle(pieces)
        line = np.concatenate(pieces)
        for at in range(0, len(line), SEQUENCE * BATCH):
            tokens = line[at:at + SEQUENCE * BATCH]
            first = np.append(np.arange(0, len(tokens), SEQUENCE), len(tokens))
            word, y = w.of_token[tokens], label[tokens]
            kinds, where = np.unique(word, return_inverse=True)
            spans = [np.arange(border[x], border[x + 1]) for x in kinds]
            of = np.repeat(np.arange(len(kinds)), [len(x) for x in spans])
            feature = index[np.concatenate(spans)]
            score = np.stack([np.bincount(of, model["weights"][feature, c], len(kinds)) for c in range(k)], 1) * share[kinds][:, None]
            score = (score + model["trust"][0] * lexical[kinds])[where]
            post = posteriors(score, first, model["transitions"])
            miss = -post
            miss[np.arange(len(y)), y] += 1
            by_kind = np.stack([np.bincount(where, miss[:, c], len(kinds)) for c in range(k)], 1)
            scaled = by_kind * share[kinds][:, None]
            step("weights", np.stack([np.bincount(feature, scaled[of, c], buckets) for c in range(k)], 1), RATE)
            step("trust", np.array([(by_kind * lexical[kinds]).sum()]), 0.02)
            step("transitions", _transition_gradient(score, first, model["transitions"], y), 0.1)
    return model


def _transition_gradient(score: np.ndarray, first: np.ndarray, transitions: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Observed less expected transitions inside the sequences."""
    k = len(transitions)
    e, t = np.exp(score - score.max(1, keepdims=True)), np.exp(transitions - transitions.max())
    size = np.diff(first)
    longest = int(size.max())
    v, forward = np.full((len(size), k), 1 / k), np.zeros((longest, len(size), k))
    for i in range(longest):
        live = size > i
        x = v[live] @ t * e[first[:-1][live] + i]
        v[live] = x / x.sum(1, keepdims=True)
        forward[i] = v
    expected = np.zeros((k, k))
    back = np.full((len(size), k), 1 / k)
    for i in range(longest - 1, 0, -1):
        live = size > i
        right = e[first[:-1][live] + i] * back[live]
        both = forward[i - 1][live][:, :, None] * t * right[:, None, :]
        expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        x = right @ t.T
        back[live] = x / x.sum(1, keepdims=True)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    return np.bincount(y[at - 1] * k + y[at], minlength=k * k).reshape(k, k) - expected


def label_words(texts: list[str], model: dict) -> list[list[str]]:
    """The most probable language of each word of each text."""
    w = Words(pa.array(texts, pa.string()))
    best = posteriors(emissions(w, model)[w.of_token], w.first, model["transitions"]).argmax(1)
    return [[model["langs"][c] for c in best[a:b]] for a, b in zip(w.first[:-1], w.first[1:])]


def predict(col: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best language (-1: none) and its mean posterior for each text."""
    n, k = len(col), len(model["langs"])
    letters = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not k:
        return np.full(n, -1), np.zeros(n)
    w = Words(col)
    post = posteriors(emissions(w, model)[w.of_token], w.first, model["transitions"])
    doc = np.repeat(np.arange(n), np.diff(w.first))
    mean = np.stack([np.bincount(doc, post[:, c], n) for c in range(k)], 1) / np.maximum(np.diff(w.first), 1)[:, None]
    return np.where(letters, mean.argmax(1), -1), np.where(letters, np.clip(mean.max(1), 0, 1), 0)


def fit(docs: DataFrame, train_windows: int = TRAIN_WINDOWS) -> dict:
    """Learn from labelled documents outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    got = draw_windows(rows, train_windows, TRAIN_CHARS, "lang").toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    return train(got["window"].to_pylist(), got["lang"].to_pylist())


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = model or fit(docs)
    k = max(1, len(model["langs"]))
    limit = min(SLICE_BYTES, max(1 << 16, SLICE_BYTES * 16 // k ** 2))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own["langs"], UNKNOWN], object)
        for batch in batches:
            for part in byte_slices(batch, "text", limit):
                best, score = predict(part.column(1), own)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score)],
                                                 names=["doc_id", "lang_pred", "score"])

    return (docs.select("doc_id", "text").mapInArrow(tasks, "doc_id long, lang_pred string, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
