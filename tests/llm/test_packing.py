import random
import zlib

import numpy as np
import pytest
from skewline.llm import packing

tokenizers = pytest.importorskip("tokenizers")


def tokenizer():
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["a word  two   spaces\n next\n\n  line ", " lead", "trail ", "", None, "tab\t x   y  z", "it's 's don't we'll 12 345",
         "<|endoftext|> x", "é日本語 😀😀 emoji", "\n b\r\n c", " \n", "x" * 5000, "word " * 9000, "a\u0085 b\x1c c"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, start string")


def check(rows, texts, capacity=2048):
    t = tokenizer()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for d, pieces in by_doc.items():
        ids = t.encode(texts[d] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padded = total = 0
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
        total += at
        padded += at if at & (at - 1) == 0 else capacity
    return 1 - total / padded


def test_pieces_are_the_tokenizers_ids(spark):
    rows = packing.pack(frame(spark, TEXTS).repartition(3)).collect()
    check(rows, TEXTS)


def test_little_padding(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["on", "the", "entation", "zq"]) for _ in range(rng.randint(0, 2000))) for _ in range(400)]
    rows = packing.pack(frame(spark, texts).repartition(4)).collect()
    assert check(rows, texts) < 0.02


def test_closed_bins_hold_the_fixed_count_of_their_class(spark):
    rows = packing.pack(frame(spark, ["on " * n for n in range(300)]).coalesce(1)).collect()
    count = {}
    for r in rows:
        if r["class"]:
            assert 2048 // (r["class"] + 1) < r.length <= 2048 // r["class"]
            count.setdefault((r.sequence_id, r["class"]), []).append(r.length)
    assert count and all(len(v) == k for (_, k), v in count.items())


def test_cuts_sum_and_waste():
    for n in range(1, 5000):
        parts = packing.cuts(n)
        assert sum(parts) == n and max(parts) <= 2048


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_repeated_rows_and_null_id(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * 3 and any(r.doc_id is None for r in rows)


def test_encoder_equals_the_tokenizer_on_odd_texts():
    rng = random.Random(7)
    encode, whole = packing.Encoder(packing.tokenizer_path()), tokenizer()
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\u0085", " ", " ", "　", "​", "a", "Word", "'s", "'ll", "12", "é", "日本",
             "😀", "é", "!", "--", "<|endoftext|>", "<|endoftext", "|>", "_", "\x00"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    assert np.frombuffer(encode("a<|endoftext|>b"), "<u4").tolist()[1] == 50256
