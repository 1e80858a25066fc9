"""Pseudo-likelihood: every word has a probability of its own."""

import numpy as np
import pyarrow as pa
import pytest

from skewline.llm import pseudolm


@pytest.fixture(scope="module")
def docs(spark):
    """Prose over 3000 words by Zipf's law (many outside the network's own 960), and random strings."""
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    vocabulary = sorted({"".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(3000)})
    p = 1 / np.arange(1, len(vocabulary) + 1)
    prose = [" ".join(rng.choice(vocabulary, 200, p=p / p.sum())) for _ in range(200)]
    junk = [" ".join("".join(rng.choice(letters, 8)) for _ in range(200)) for _ in range(60)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(prose + junk)], "doc_id long, text string").repartition(2).cache()


def test_gibberish_scores_below_prose(docs):
    got = {r.doc_id: r.mean_log_prob for r in pseudolm.score(docs).collect()}
    assert len(got) == 260
    assert max(got[i] for i in range(200, 260)) < min(got[i] for i in range(200))


def test_words_of_a_class_share_its_probability(docs):
    vocab = pseudolm.vocabulary(docs)
    counted = vocab.ids >= vocab.spelled - pseudolm.OTHER
    assert counted.sum() > 500
    share = np.bincount(vocab.ids[counted], np.exp(vocab.inside[counted]))
    assert np.allclose(share[share > 0], 1)
    # A row of the spelling table is a distribution; a longer unknown word is less likely.
    table = vocab.spelling.reshape(256, 256).astype(float)
    assert np.allclose(np.where(table < 0, np.exp(table), 0).sum(1), 1, atol=1e-4)
    token, inside, first = pseudolm.classes(pa.array(["qqzzx qqzzxqqzzx", None]), vocab)
    assert list(token) == [vocab.spelled] * 2 and inside[1] < inside[0] < 0 and list(first) == [0, 2, 2]


def test_vocabulary_grows(spark):
    small, large = (spark.range(n).selectExpr("concat('w', id % 1200) text") for n in (3000, 300_000))
    assert pseudolm.vocabulary(large).spelled > pseudolm.vocabulary(small).spelled == 960 + pseudolm.OTHER
    empty = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert pseudolm.score(empty).first().asDict() == {"doc_id": 1, "n_words": 0, "log_prob": 0.0, "mean_log_prob": None}
