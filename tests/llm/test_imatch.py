import hashlib
import math
import random
import re
import struct

import pytest
from skewline.llm import imatch

xxhash = pytest.importorskip("xxhash")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def term(t):
    return signed(xxhash.xxh64(t.encode(), seed=42).intdigest())


def chain(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
    return signed(seed)


def folded(values):
    out = chain(values[:1])
    for v in values[1:]:
        out = chain([out, v])
    return out


def brute(texts):
    """Fingerprints of texts (all documents) and a function for more texts."""
    terms = lambda t: sorted({term(w) for w in re.split("[\x09-\x0d\x20]+", t.lower()) if w})
    df = {}
    distinct = {t or "" for t in texts}
    for t in distinct:
        for b in {h % imatch.BUCKETS for h in terms(t)}:
            df[b] = df.get(b, 0) + 1
    low, high = imatch.LEAST_SHARE * len(distinct), max(1, imatch.MOST_SHARE * len(distinct))

    def level(h):
        c = df.get(h % imatch.BUCKETS)
        if c is None:
            return imatch.FAR
        ratio = low / c if c < low else c / high if c > high else None
        return 0 if ratio is None else min(imatch.FAR, 1 + int(math.log2(ratio)))

    def fingerprint(text):
        every = sorted((level(h), h % (1 << 60)) for h in terms(text))
        inside = sum(k == 0 for k, _ in every)
        kept = sorted(h for _, h in every[:max(inside, -(-len(every) // imatch.FEW))])
        subsets = {}
        for h in kept:
            x, scale = h >> (imatch.BUCKET_BITS + 3), 0
            while scale < imatch.SCALES - 1 and not x >> scale & 1:
                scale += 1
            subset = scale * imatch.PARTS + (h >> imatch.BUCKET_BITS) % imatch.PARTS
            subsets.setdefault(subset, []).append(subset << 56 | h % (1 << 56))
        out = {s: s << 56 | folded(sorted(v)) % (1 << 56) for s, v in subsets.items() if len(v) <= imatch.SPARSE}
        return chain(kept), out

    return fingerprint


def likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    either = set(a[1]) | set(b[1])
    return sum(a[1].get(s) == b[1].get(s) for s in either) / len(either) if either else 0.0


def written(p):
    return "-".join(f"{x % (1 << 64):x}" for x in [p[0], *(p[1][s] for s in sorted(p[1]))])


def corpus(n):
    rng = random.Random(8)
    words = [f"Wörd{i}" for i in range(400)]
    rows = []
    for i in range(n):
        t = "  ".join(rng.choice(words) if rng.random() < 0.7 else f"own{i}x{rng.random()}" for _ in range(rng.choice([0, 1, 3, 60, 400])))
        rows.append((3 * i + i % 2, rng.choice([t, t, t, t, None, "same words here", "😀é" * rng.randint(0, 9)])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_chars string")


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_DOCS", 7)
    rows = corpus(150)
    got = {r.doc_id: r for r in imatch.fingerprints(frame(spark, rows).repartition(5)).collect()}
    fingerprint = brute([t for _, t in rows])
    down = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(down):
        t, other = t or "", down[(k + 1) % len(down)][1] or ""
        edited = t[:len(t) - len(t) // 2] + other[:len(t) // 2]
        r, a, b = got[i], fingerprint(t), fingerprint(edited)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (written(a), written(b))
        assert abs(r.near_edited - likeness(a, b)) < 1e-12 and abs(r.near_next - likeness(a, fingerprint(other))) < 1e-12
    same = {r.fingerprint for r, t in ((got[i], t) for i, t in rows) if t == "same words here"}
    assert len(same) == 1


def test_near_copies_are_nearer_than_others(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choices(words, k=300) for _ in range(40)]
    rows = []
    for i, b in enumerate(base):
        rows += [(2 * i, " ".join(b)), (2 * i + 1, " ".join(w if rng.random() > 0.02 else "zz" for w in b))]
    out = imatch.fingerprints(frame(spark, rows)).collect()
    near = [r.near_next for r in out if r.doc_id % 2]
    far = [r.near_next for r in out if not r.doc_id % 2]
    assert min(near) > max(far) and sum(near) / len(near) > 0.6


def test_odd_tables(spark):
    one = imatch.fingerprints(frame(spark, [(5, "ab cd")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and one[0].near_next == 1.0
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "x"), (None, "n"), (None, None), (0, ""), (2, "y" * 2_000_000 + " z")]
    out = imatch.fingerprints(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert imatch.fingerprints(frame(spark, [(None, "n"), (None, "m")])).count() == 2
    assert imatch.fingerprints(frame(spark, [])).count() == 0


def test_no_python_on_the_executors(spark):
    plan = imatch.fingerprints(frame(spark, [(1, "a b"), (2, "b c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_one_term_more_moves_few_subsets(spark):
    """Where the band runs out of terms, nothing jumps: prints of texts one term apart are alike on
    both sides of the share that is completed."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(40)]
    for inside in range(8, 15):
        base = rng.sample(common, 40 - inside) + [f"in{j}" for j in range(inside)]
        rows = [(0, " ".join(base + ["in900"])), (1, " ".join(base))]
        rows += [(i, " ".join(common)) for i in range(2, 60)] + [(i, " ".join(f"in{j}" for j in [*range(20), 900]) + f" x{i}") for i in range(60, 68)]
        out = {r.doc_id: r for r in imatch.fingerprints(frame(spark, [(i, t + f" u{i}" if i > 1 else t) for i, t in rows])).collect()}
        assert out[1].near_next > 0.5, inside


def test_more_ranges_than_a_row_is_compared_with(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_DOCS", 2)
    rng = random.Random(9)
    ids = rng.sample(range(-500, 500), 300)
    rows = [(i, f"text {i}") for i in ids] + [(None, "none")]
    got = {r.doc_id: r for r in imatch.fingerprints(frame(spark, rows).repartition(4)).collect()}
    down = sorted(ids, reverse=True)
    order = [*down, None]
    for a, b in zip(order, [*order[1:], order[0]]):
        t, other = next(t for i, t in rows if i == a), next(t for i, t in rows if i == b)
        assert got[a].edited_sha256 == hashlib.sha256((t[:len(t) - len(t) // 2] + other[:len(t) // 2]).encode()).hexdigest()
