import random
import re

import numpy as np
import pyarrow as pa
from skewline.llm import ngramjoin as nj


def grams(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows, threshold=0.8):
    sets = {i: grams(t) for i, t in rows}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}
             for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), len(links[i]))
    return out


def edited(rng, words, rate):
    return [rng.choice(VOCABULARY) if rng.random() < rate else w for w in words]


VOCABULARY = [f"w{i}" for i in range(3000)]


def corpus(n, seed):
    rng = random.Random(seed)
    passage = [rng.choice(VOCABULARY) for _ in range(40)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = edited(rng, rows[rng.randrange(len(rows))][1].split(), rng.choice([0, 0.01, 0.02, 0.04]))
        else:
            words = [rng.choice(VOCABULARY) for _ in range(rng.choice([3, 30, 200]))] + (passage if rng.random() < 0.4 else [])
        rows.append((i, " ".join(words)))
    return rows


def result(df, **options):
    return {r.doc_id: (r.class_id, r.n_links) for r in nj.near_duplicates(df, **options).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, size string")


def test_against_brute_force(spark):
    rows = corpus(400, 1)
    assert result(frame(spark, rows)) == brute(rows)


def test_small_buckets_split_and_tile(spark):
    rng = random.Random(4)
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.01))) for i in range(120)] + [(i + 1000, t) for i, t in corpus(80, 5)]
    want = brute(rows)
    assert result(frame(spark, rows), bucket=8, depth=3) == want and max(n for _, n in want.values()) > 50


def test_copies_are_one_representative(spark):
    rows = [(i, "a b c d e f g  h") for i in range(5, 300)] + [(1, "a b c d e f g h"), (2, "other words are here now")]
    got = result(frame(spark, rows))
    assert got[2] == (2, 0) and got[1] == (1, 295) and {got[i] for i in range(5, 300)} == {(1, 295)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (6, "one two"), (7, "x " * 300_000), (8, "x " * 250_000), (9, None), (4, "one")]
    df = frame(spark, rows).union(spark.createDataFrame([(None, "one", "x")], "doc_id long, text string, size string"))
    out = nj.near_duplicates(df).collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in out}
    want = brute([r for r in rows if r[0] is not None])
    want[None] = (None, 0)
    assert got == want and len(out) == 10
    assert nj.near_duplicates(df.limit(0)).count() == 0


def test_runs_follow_the_recall():
    assert nj.runs_needed(recall=0.9) < nj.runs_needed(recall=0.999) < nj.runs_needed(recall=0.999999)
    assert nj.runs_needed(depth=1) < nj.runs_needed(depth=4)


def test_overlap_by_product_and_by_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 100)).astype("<u4") for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert nj.overlaps(sets, i, j).tolist() == want
    assert nj.overlaps(sets, i[:3], j[:3]).tolist() == want[:3]


def test_groups_over_batch_borders():
    keys = np.array([0, 0, 1, 1, 1, 1, 2, 3, 3])
    for size in range(1, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:a + size])], names=["k"]) for a in range(0, len(keys), size)]
        seen = [t["k"].to_pylist() for t in nj.runs_of_groups(iter(batches), ["k"])]
        assert sum(seen, []) == keys.tolist()
        assert len({k for t in seen for k in set(t)}) == sum(len(set(t)) for t in seen)


def test_one_document_of_each_class_stays(spark):
    rows = corpus(200, 7) + [(500, "one two three"), (500, "one two three"), (None, "one two three"), (None, None)]
    kept = nj.keep_one(frame(spark, rows)).collect()
    want = brute([r for r in rows if r[0] is not None])
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({i for i, (c, _) in want.items() if c == i})
    assert sum(r.doc_id is None for r in kept) == 2 and {r["size"] for r in kept} == {"x"}
