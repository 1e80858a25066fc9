import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from skewline.llm import pseudolm as lm

SF01 = "/root/testdata/sf0.01"


def test_probabilities_sum_to_one_and_gradients_are_slopes():
    share = np.random.default_rng(2).random(1024)
    outside = len(share)
    net = {k: v.astype(np.float64) for k, v in lm.new_network(share / share.sum(), 32).items()}
    beside = np.array([[3, 5, outside, 70]])
    logs = [lm.log_probabilities(net, np.array([c]), beside)[0] for c in range(outside)]
    assert abs(np.exp(logs).sum() - 1) < 1e-9
    token, beside = np.array([3, 40, 900]), np.array([[1, 2, 3, 4], [5, 5, outside, 7], [1, 1023, 0, 9]])
    gradient = {}
    lm.log_probabilities(net, token, beside, gradient)
    rng = np.random.default_rng(1)
    for k, g in gradient.items():
        at = tuple(rng.integers(0, s) for s in g.shape) if k not in ("embed", "word") else np.unravel_index(np.abs(g).argmax(), g.shape)
        slopes = []
        for d in (1e-5, -1e-5):
            moved = {**net, k: net[k].copy()}
            moved[k][at] += d
            slopes.append(lm.log_probabilities(moved, token, beside).sum())
        assert abs((slopes[0] - slopes[1]) / 2e-5 - g[at]) < 1e-4, k


def test_contexts_stay_inside_texts():
    o = 99
    got = lm.contexts(np.array([1, 2, 3, 4]), np.array([0, 3, 3, 4]), o)
    assert got.tolist() == [[o, o, 2, 3], [o, 1, 3, o], [1, 2, o, o], [o, o, o, o]]


def test_classes_follow_the_vocabulary():
    known, ids = lm.word_hashes(*(lambda d, o: (d, o[:-1], o[1:]))(*lm.text_bytes(pa.array(["the", "éa"])))), np.array([0, 1])
    order = np.argsort(known)
    vocab = lm.Words(known[order], ids[order], np.zeros(2, np.float32), np.full(1 << 16, -1, np.float32), np.full(4, 0.25), 3, 2, 10)
    got, inside, first = lm.classes(pa.array(["The ÉA, the! zz", None, ""]), vocab)
    assert got.tolist() == [0, 1, 0, 3] and first.tolist() == [0, 4, 4, 4] and inside.tolist() == [0, 0, 0, -3]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")


def test_training_beats_word_frequencies_and_the_start(spark, docs):
    vocab = lm.vocabulary(docs)
    start = lm.warm_start(docs, vocab, 100)
    net = lm.train(docs, start, vocab)
    token, _, first = lm.classes(pa.array([r.text for r in docs.collect()]), vocab)
    n = len(vocab.share)
    beside = lm.contexts(token, first, n)
    mean = [lm.log_probabilities(x, token, beside).mean() for x in (start.net, net)]
    own = np.bincount(token, minlength=n) / len(token)
    frequent = vocab.spelled - lm.OTHER
    assert np.abs(own[:frequent] - vocab.share[:frequent]).max() < 1e-3 and vocab.total == len(token)
    assert mean[1] > mean[0] and mean[1] > np.log(own[token]).mean() + 0.1


def test_trainers_follow_the_words(spark, docs, monkeypatch):
    """Blocks are averaged over trainers by their words, whatever the number of trainers."""
    vocab = lm.vocabulary(docs)
    start = lm.warm_start(docs, vocab, 50)
    monkeypatch.setattr(lm, "LEAST_TRAINERS", 3)
    few = docs.where("doc_id % 10 = 0").select("text").repartition(3).cache()
    got = lm.flat(lm.train(few, start, vocab))
    want, words = 0, 0
    for rows in few.rdd.glom().collect():
        own = lm.Trainer(start.net, lm.RATE, start.sums)
        token, _, first = lm.classes(pa.array([r.text for r in rows], pa.string()), vocab)
        own.add(token, lm.contexts(token, first, len(vocab.share)), last=True)
        want, words = want + lm.flat(own.net).astype(float) * own.words, words + own.words
    assert np.abs(got - want / words).max() < 1e-4


def test_scores_tell_shuffled_text(spark, docs):
    rng = np.random.default_rng(4)
    rows = [r for r in docs.collect() if len(r.text.split()) > 100][:60]
    mixed = [(r.doc_id + 10_000, " ".join(rng.permutation(" ".join(x.text for x in rows[i:i + 4]).split())[:len(r.text.split())])) for i, r in enumerate(rows)]
    out = {r.doc_id: r for r in lm.score(docs.union(spark.createDataFrame(mixed, "doc_id long, text string")), 100).collect()}
    assert all(abs(r.mean_log_prob - r.log_prob / r.n_words) < 1e-9 for r in out.values() if r.n_words)
    assert np.mean([out[r.doc_id].mean_log_prob > out[r.doc_id + 10_000].mean_log_prob for r in rows]) > 0.6


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "!!", "x"), (4, "word", "x"), (4, "word", "x"), (None, "a b", "x"), (5, "w " * 300_000, "x")]
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert sorted(r.n_words for r in out) == [0, 0, 0, 1, 1, 2, 300_000] and all((r.mean_log_prob is None) == (r.n_words == 0) for r in out)
    assert lm.score(spark.createDataFrame(rows, "doc_id long, text string, n_words string").where(F.lit(False))).count() == 0
