import hashlib
import random
import re

import numpy as np
from skewline.llm import pii

# The base patterns as given, tried literally.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def doubled(d):
    return sum(divmod(2 * int(d), 10))


def literal(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = digits(m)
        total = sum(int(c) for c in d[-1::-2]) + sum(doubled(c) for c in d[-2::-2])
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


SAMPLES = ["", "a@b.c@d.e x@y", "@a.b", "a.b@-.-..c", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.2.3.0255 1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111-",
           "+1 (017) 555-7713 +1 +33 1 23 45 67 89.", "+12+34567890123", "79927398713 0000000000000000 00000000000000000000", "é😀a@b.co é", "a@b.c.@d.e.f",
           "00000000000000000001.2.3.4", "+1234567890 12345", "a@@b.c", "1..2.3.4.5"]


def test_base_spans_are_the_literal_patterns():
    rng = random.Random(2)
    texts = SAMPLES + ["".join(rng.choice("ab@.@.-+1209 (é)") for _ in range(rng.randint(1, 60))) for _ in range(5000)]
    texts += ["".join(rng.choice("0123 -.+") for _ in range(80)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == literal(t), t


def test_long_runs_are_linear():
    for t in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1 " * 500_000, "a@" * 500_000, "1 " * 1_000_000, "a.b@" + "c." * 500_000):
        pii._describe(t)


def test_candidates_do_not_overlap():
    rng = random.Random(3)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "@", ".", "com", "12", "345", "6789", " ", "-", "+", "(", ")", "f0e1d2c3b4a5968778695a4b"]) for _ in range(30))
        base = pii.base_spans(t)
        found = pii.candidates(t, base)
        assert set(base) <= set(found)
        extra = sorted(set(found) - set(base))
        for s in extra:
            assert all(s == o or s[2] <= o[0] or o[2] <= s[0] for o in found)


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(1)
    n = 20_000
    truth = rng.random(n) < 0.3
    right = (0.95, 0.9, 0.85, 0.55)
    said = np.stack([np.where(rng.random(n) < 0.3, pii.ABSTAIN, np.where((rng.random(n) < r) == truth, pii.YES, pii.NO)) for r in right], 1)
    codes = (said * 3 ** np.arange(4)).sum(1)
    seen, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
    p = pii.reliabilities(np.zeros(len(seen), int), seen, counts)[at]
    yes, no = (said == pii.YES).sum(1), (said == pii.NO).sum(1)
    assert ((p > 0.5) == truth).mean() > max(0.9, ((yes > no) == truth).mean())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long")


def test_results_and_added_spans(spark):
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    rows = [(i, t, "x", 0) for i, t in enumerate(SAMPLES)] + [(100, None, "x", None), (100, "", "y", 0)]
    rows += [(200 + i, f"call +1 (017) 555-77{i:02d} or mail a{i}@mail.example.com, {secret} version 300.2.3.4", "x", 0) for i in range(60)]
    out = pii.find(frame(spark, rows)).collect()
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    assert len(out) == len(rows)
    for r in out:
        base = literal(texts[r.doc_id][0])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        line = pii.written(base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r.spans.split(","))
        if r.doc_id >= 200:
            assert "secret:" in r.spans and r.spans.count("ip:") == 0


def test_mask(spark):
    rows = [(1, "é call +1 (017) 555-7713, a@b.co!", "x", 5), (2, None, "x", None), (3, "clean text", "x", 10)]
    got = {r.doc_id: r for r in pii.mask(frame(spark, rows)).collect()}
    assert got[1].text == "é call <PHONE>, <EMAIL>!" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[2].n_chars is None and got[3].text == "clean text" and got[3].base == "x"
    assert pii.find(frame(spark, []).limit(0)).count() == 0 and pii.mask(frame(spark, [])).count() == 0
