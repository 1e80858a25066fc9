"""I-Match fingerprints under copies, near copies and rare terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewline.llm import imatch


def _text(rng, vocabulary, n=120):
    return list(rng.choice(vocabulary, n))


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(4)


def _frame(spark, texts):
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_near_copies_holding_a_third_are_alike(spark, rng):
    common = [f"c{i}" for i in range(2000)]
    base = [f"base{i}" for i in range(120)]
    near = []
    for _ in range(100):
        copy = list(base)
        for at in rng.choice(120, 4, replace=False):
            copy[at] = rng.choice(common)
        near.append(copy)
    got = imatch.fingerprints(_frame(spark, near + [_text(rng, common) for _ in range(200)])).collect()
    assert len(got) == 300
    # The next row goes by descending doc_id, so that of 1 to 99 is a near copy, and that of 101 on is not.
    assert min(r.near_next for r in got if 1 <= r.doc_id < 100) > 0.1
    assert np.mean([r.near_next for r in got if 1 <= r.doc_id < 100]) > 0.5
    assert max(r.near_next for r in got if r.doc_id > 100) < 0.1


def test_copies_do_not_change_the_lexicon(spark, rng):
    common = [f"c{i}" for i in range(400)]
    texts = [_text(rng, common, 30) for _ in range(100)] + [[f"own{i}" for i in range(50)]]
    docs = _frame(spark, texts)
    copies = docs.union(docs.where("doc_id = 100").crossJoin(spark.range(60)).select(F.col("id") + 1000, "text"))
    alone, among = (d.select(imatch.lexicon(d).alias("levels")).first().levels for d in (docs, copies))
    assert alone == among and any(among)


def test_terms_below_the_band_still_tell_near_copies(spark, rng):
    common = [f"c{i}" for i in range(400)]
    rare = [f"rare{i}" for i in range(60)]
    texts = [_text(rng, common) for _ in range(200)] + [rare, rare[:-2] + ["other", "end"]]
    got = {r.doc_id: r for r in imatch.fingerprints(_frame(spark, texts), least=0.02).collect()}
    assert got[201].near_next > 0.4 and got[200].near_next < 0.1
