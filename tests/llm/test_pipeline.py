import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

from skewline.llm import packing, pii

SF01 = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def grams(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF01}/documents.parquet"), []
    out.append(docs.toPandas())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF01).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_stages_keep_the_columns(steps):
    for s in steps[:-1]:
        assert list(s.columns) == COLUMNS


def test_quality_stage_keeps_what_labels_call_good(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    kept = set(steps[1].doc_id)
    good, bad = ([i for i in steps[0].doc_id if labels.get(i) == q] for q in (1, 0))
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i in bad) <= 0.02 * len(bad)
    assert steps[1].set_index("doc_id").text.equals(steps[0].set_index("doc_id").text.loc[steps[1].doc_id])


def test_no_near_duplicates_remain_and_only_they_go(steps):
    before, after = steps[1], set(steps[2].doc_id)
    sets = {i: grams(t) for i, t in zip(before.doc_id, before.text)}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    count = {}
    for own in holders.values():
        for a in own:
            for b in own:
                if a < b:
                    count[a, b] = count.get((a, b), 0) + 1
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), c in count.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert after == {find(i) for i in sets}


def test_personal_data_is_masked(steps):
    assert sorted(steps[3].doc_id) == sorted(steps[2].doc_id)
    for t, n in zip(steps[3].text, steps[3].n_chars):
        assert not pii.base_spans(t) and len(t) == n
    before = dict(zip(steps[2].doc_id, steps[2].text))
    same = sum(before[i] == t for i, t in zip(steps[3].doc_id, steps[3].text))
    clean = [t for t in before.values() if not any(c.isdigit() or c == "@" for c in t)]
    assert same >= len(clean)


def test_mix_meets_the_targets(steps):
    before, after = steps[3], steps[4]
    words = lambda f: f.text.str.split().str.len()
    sizes, got = words(before).groupby(before.source).sum(), words(after).groupby(after.source).sum()
    names = sorted(sizes.index)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sizes.sum())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    longest = words(before).groupby(before.source).max()
    for s in names:
        assert abs(got.get(s, 0) - target[s]) <= longest[s] + 20
    assert after.groupby("doc_id").size().max() <= 3


def test_packing_holds_every_id_once(steps):
    encode = packing.Encoder(packing.tokenizer_path())
    by_doc = dict(zip(steps[4].doc_id, steps[4].text))
    times = steps[4].groupby("doc_id").size()
    out = steps[5]
    assert out.groupby("doc_id").length.sum().equals((out.groupby("doc_id").doc_tokens.first() * times).rename("length"))
    for r in random.Random(1).sample(list(out.itertuples()), 200):
        ids = encode(by_doc[r.doc_id]) + (1).to_bytes(4, "little")
        assert len(ids) == 4 * r.doc_tokens and zlib.crc32(ids[4 * r.start:4 * (r.start + r.length)]) == r.ids_crc32
    filled = out.groupby("sequence_id").length.sum()
    padded = np.where(np.log2(filled) % 1 == 0, filled, 2048).sum()
    assert filled.max() <= 2048 and 1 - filled.sum() / padded < 0.03


def test_run_is_all_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF01).toPandas()
    assert sorted(got.groupby("doc_id").length.sum().items()) == sorted(steps[5].groupby("doc_id").length.sum().items())


def test_stages_on_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a@b.co x y z w v", "en", "a", 15), (3, "word " * 50_000, "en", None, 250_000),
            (3, "word " * 50_000, "en", None, 250_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF01).count() >= 0
        assert stage(spark, docs.limit(0), SF01).count() == 0
