import heapq
import random
import re
from fractions import Fraction

from skewline.llm import mixing


def targets(sizes):
    """Water filling by rounds: cap what is above 3 times its size, reshare the rest."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, Fraction(sum(sizes.values())), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not full:
            out |= {s: level * weight[s] for s in free}
            break
        for s in full:
            out[s] = Fraction(3 * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target int")


def make(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 300, 900]))), rng.choice(["a", "a", "a", "Z", "é", "b", None, "tiny" if i == 3 else "a"]), "x", 1)
            for i in range(n)]


def test_targets_and_bounds(spark):
    rows = make(900, 1) + [(10_000, None, "nulls", "x", 1), (10_001, "\t\x0b a b ", "sp", "x", 1)]
    out = mixing.mix_sources(frame(spark, rows)).collect()
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want, taken = targets(sizes), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(out) == len(rows)
    for s, w in want.items():
        assert abs(taken[s] - w) <= 2 * mixing.BLOCK_WORDS


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(3)
    cells = [(g, c, rng.choice([0.0, 1.0, rng.random() * 1000]), seats) for g, n, seats in ((0, 1, 7), (1, 9, 4), (2, 40, 1000), (3, 25, 0))
             for c in range(n)]
    df = spark.createDataFrame(cells, "g int, c int, votes double, seats long")
    got = {(r.g, r.c): r.quota for r in mixing.sainte_lague(df, ["g"], "c").collect()}
    for g in range(4):
        own = [(c, v) for x, c, v, _ in cells if x == g]
        seats = next(s for x, _, _, s in cells if x == g)
        heap = [(-v, c, 0) for c, v in own if v > 0]
        heapq.heapify(heap)
        won = dict.fromkeys([c for c, _ in own], 0)
        votes = dict(own)
        for _ in range(seats):
            _, c, j = heapq.heappop(heap)
            won[c] += 1
            heapq.heappush(heap, (-votes[c] / (2 * j + 3), c, j + 1))
        assert {c: got[g, c] for c, _ in own} == won


def test_reruns_agree_and_seed_matters(spark):
    df = frame(spark, make(200, 2))
    a = sorted(mixing.mix_sources(df).collect(), key=str)
    assert a == sorted(mixing.mix_sources(df.repartition(5)).collect(), key=str)
    assert a != sorted(mixing.mix_sources(df, seed="other").collect(), key=str)


def test_empty_and_wordless_tables(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    out = mixing.mix_sources(frame(spark, [(1, None, None, "x", 1), (2, " ", "a", "x", 1)])).collect()
    assert [r.taken for r in out] == [0, 0] and [r.target for r in out] == [0.0, 0.0]


def test_repeated_rows_are_separate(spark):
    out = mixing.mix_sources(frame(spark, [(1, "a b", "s", "x", 1)] * 4)).collect()
    assert len(out) == 4 and sum(r.taken for r in out) == 8


def test_mixed_documents(spark):
    rows = make(300, 5)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix_sources(frame(spark, rows)).collect()}
    out = mixing.mixed_documents(frame(spark, rows)).collect()
    times = {}
    for r in out:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert (r.doc_id, r.text, r.source, r["size"], r["target"]) == rows[r.doc_id]
    for i, (t, size) in taken.items():
        assert times.get(i, 0) == (int(t / size + 0.5) if size else 0)


def test_null_ids_of_one_size_are_rounded_one_by_one(spark):
    """A third of the rows has no doc_id: their words still meet the target, as whole documents too."""
    text = lambda i: " ".join(f"w{i}" for _ in range(100))
    rows = [(None, text(i), "b", "x", 1) for i in range(300)] + [(i, text(i), "a", "x", 1) for i in range(600)]
    out = mixing.mix_sources(frame(spark, rows).repartition(4), shard_docs=50).collect()
    taken = {s: sum(r.taken for r in out if r.source == s) for s in "ab"}
    target = {r.source: r.target for r in out}
    assert len(out) == 900 and all(abs(taken[s] - target[s]) <= 8 for s in "ab")
    mixed = mixing.mixed_documents(frame(spark, rows).repartition(4)).collect()
    words = {s: 100 * sum(r.source == s for r in mixed) for s in "ab"}
    assert all(abs(words[s] - target[s]) <= 100 for s in "ab")


def test_a_source_with_little_taken_keeps_a_document(spark):
    rows = [(None, " ".join(f"w{i}" for _ in range(1000)), "b", "x", 1) for i in range(250)] + [(i, "two words", "a", "x", 1) for i in range(90)]
    rows += [(1000 + i, "w " * 40, c, "x", 1) for i, c in enumerate("cdefgh" * 3)]
    out = mixing.mix_sources(frame(spark, rows), weights=(1e9, 1, 1, 1, 1, 1, 1, 1)).collect()
    assert {r.source for r in mixing.mixed_documents(frame(spark, rows)).collect()} == set("abcdefgh")
    assert len(out) == len(rows)


def test_hot_copies_spread_over_shards_and_share_their_words(spark):
    rows = [(7, "same words here", "a", "x", 1)] * 400 + [(i, f"t{i} other", "a", "x", 1) for i in range(100, 500)] + [(9, "b b", "b", "x", 1)]
    items = mixing.takes(frame(spark, rows).repartition(5), shard_docs=3).collect()
    assert sorted(r.copies for r in items if r.doc_id == 7) == [16, 64, 64, 64, 64, 64, 64]
    out = mixing.mix_sources(frame(spark, rows).repartition(3), shard_docs=3).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in out)
    assert sum(r.taken for r in out if r.doc_id == 7) == sum(r.taken for r in items if r.doc_id == 7)
    mixed = mixing.mixed_documents(frame(spark, rows)).collect()
    assert sum(r.doc_id == 9 for r in mixed) <= 3 and abs(sum(len(r.text.split()) for r in mixed) - sum(r.taken for r in out)) <= 9
