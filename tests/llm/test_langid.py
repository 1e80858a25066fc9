import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from skewline.llm import langid

SF01 = "/root/testdata/sf0.01"


def enumerate_paths(e, t):
    n, k = e.shape
    post = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = np.exp(t[:, path[0]]).mean() * np.exp(e[0, path[0]])
        for a, b, i in zip(path, path[1:], range(1, n)):
            weight *= np.exp(t[a, b] + e[i, b])
        for i, c in enumerate(path):
            post[i, c] += weight
    return post / post.sum(1, keepdims=True)


@pytest.mark.parametrize("block", [1, 2, 3, 50])
def test_forward_backward_is_the_sum_over_paths(block):
    rng = np.random.default_rng(1)
    t, first = rng.normal(size=(3, 3)), np.array([0, 1, 1, 6, 8])
    e = rng.normal(size=(8, 3)) * 2
    got = langid.posteriors(e, first, t, block)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert np.allclose(got[a:b], enumerate_paths(e[a:b], t))


def test_transition_gradient():
    rng = np.random.default_rng(2)
    e, t, first, y = rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), np.array([0, 3, 5]), np.array([0, 1, 1, 0, 0])

    def likelihood(t):
        out = 0
        for a, b in zip(first[:-1], first[1:]):
            def weight(p):
                return sum(e[a + i, c] for i, c in enumerate(p)) + sum(t[c, d] for c, d in zip(p, p[1:]))
            out += weight(y[a:b]) - np.log(sum(np.exp(weight(p)) for p in itertools.product(range(2), repeat=b - a)))
        return out

    got = langid._transition_gradient(e, first, t, y)
    for i, j in itertools.product(range(2), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-5
        slope = (likelihood(t + d) - likelihood(t - d)) / 2e-5
        # The start is uniform over a state before the first word, outside this likelihood.
        assert abs(slope - got[i, j]) < 0.35 * max(1, abs(slope))


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{SF01}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = langid.identify(docs, model).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_words_of_switched_text(spark, model):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("lang in ('de', 'es')").orderBy("doc_id").limit(40).collect()
    de = next(r.text for r in docs if r.lang == "de" and r.n_chars > 1500).split()[:120]
    es = next(r.text for r in docs if r.lang == "es" and r.n_chars > 1500).split()[:80]
    labels = langid.label_words([" ".join(de[:60] + es + de[60:])], model)[0]
    want = ["de"] * 60 + ["es"] * 80 + ["de"] * 60
    if len(labels) == len(want):
        assert np.mean([a == b for a, b in zip(labels, want)]) > 0.9
    assert np.abs(np.diag(model["transitions"]) - 0).min() > model["transitions"][~np.eye(len(model["langs"]), dtype=bool)].max()


def test_prediction_does_not_depend_on_its_batch(model):
    rng = random.Random(3)
    texts = ["der und schon " * 700, "", "the of", None, "12 !", "é", "日本", "x" * 100_000] + ["la de que ción " * rng.randint(1, 50) for _ in range(9)]
    whole = langid.predict(pa.array(texts, pa.string()), model)
    for i, t in enumerate(texts):
        one = langid.predict(pa.array([t], pa.string()), model)
        assert one[0][0] == whole[0][i] and abs(one[1][0] - whole[1][i]) < 1e-9
        assert (whole[0][i] == -1) == (t in ("", None, "12 !"))


def test_odd_tables(spark, model):
    rows = [(1, None, "en", "x"), (2, "42 ...", "en", "x"), (None, "the of and", None, "x"), (3, "und der", "de", "x"), (3, "und der", "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.identify(df, model).collect()
    assert len(out) == 5 and [r.lang_pred for r in out if r.doc_id in (1, 2)] == ["und", "und"]
    assert not any(r.held_out for r in out if r.doc_id is None)
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.identify(df).count() == 5 and langid.identify(df.limit(0)).count() == 0
