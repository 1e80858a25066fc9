import random
from collections import Counter

import numpy as np
import pytest
from skewline.llm import suffixdedup as sd


def brute(texts, length):
    """Removed spans and kept bytes of each text, from all its windows."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])))
        out.append(([(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])], bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])))
    return out


def texts_with_repeats(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(length // 3, length)) for _ in range(6)]
    hot = prose(length // 4)
    out = [None, "", "short", "x" * (3 * length), "x" * (length + 1), "ab" * length, prose(3) + "\0" * (length + 9), "\0" * length]
    out += [" ".join([prose(20), rng.choice(passages), prose(rng.randrange(40)), hot, prose(9)]) for _ in range(60)]
    out += [hot + f" {i} " + hot for i in range(40)]
    out += [out[20], out[20], out[21] + "tail"]
    line = prose(5) + "\n"
    return out + [line * (length // 4), prose(300), (line * 9)[:length]]


def frame(spark, texts, parts=6):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id long, text string, row string, g int").repartition(parts)


def check(got, texts, length):
    want = brute(texts, length)
    for r in got:
        spans, kept = want[r.doc_id]
        assert [(s.start, s.end) for s in r.spans] == spans and bytes(r.kept) == kept and r.n_bytes == len((texts[r.doc_id] or "").encode())
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    return want


@pytest.mark.parametrize("shard_bytes, group_contexts", [(1 << 20, 2048), (700, 3)])
def test_against_all_windows(spark, shard_bytes, group_contexts):
    length = 40
    texts = texts_with_repeats(1, length)
    got = sd.remove_repeats(frame(spark, texts), length, 8, shard_bytes, group_contexts).collect()
    want = check(got, texts, length)
    assert 30 < sum(bool(s) for s, _ in want) and any(len(s) > 1 for s, _ in want)


def test_contract_length_and_hot_texts(spark):
    texts = texts_with_repeats(2, 200) + ["one long copied text " + "word " * 90] * 60
    check(sd.remove_repeats(frame(spark, texts, 9)).collect(), texts, 200)


def test_very_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcd ") for _ in range(900))
    texts = ["".join(rng.choice("abcdef ") for _ in range(5000)) + passage + "z" * 700, passage[100:800] + " " + "y" * 500, "q" * 40]
    monkeypatch.setattr(sd, "_SLICE", 512)
    data = [t.encode() for t in texts]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(data, pa.binary())], names=["row", "data"])
    windows = Counter()
    for rows, bases, part, offsets in sd.pieces(iter([batch]), 200):
        g, start, size, _ = sd.anchors(part, offsets, 200, 64)
        text = np.searchsorted(offsets, start, side="right") - 1
        for t, s, n in zip(text, start - offsets[text] + np.array(bases)[text], size):
            windows.update((rows[t], int(s) + k) for k in range(n))
    assert windows == Counter((r, i) for r, d in enumerate(data) for i in range(len(d) - 199))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    same = bytes(rng.choice(b"ab ") for _ in range(400))
    a, b = same + bytes(rng.choice(b"abc") for _ in range(300)), bytes(rng.choice(b"abc") for _ in range(77)) + same
    got = []
    for text in (a, b):
        g, start, size, _ = sd.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 200, 64)
        assert start.tolist() == np.cumsum([0, *size[:-1]]).tolist() and size.sum() == len(text) - 199
        got.append(np.repeat(g, size))
    assert got[0][:201].tolist() == got[1][77:278].tolist()


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 3, 900), np.zeros(300), np.tile([1, 2, 0], 200), rng.integers(0, 256, 500), np.array([5])):
        data = data.astype(np.uint8)
        raw = data.tobytes()
        sa, rank = sd.suffix_array(data)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert sa.tolist() == want and rank[sa].tolist() == list(range(len(raw)))
        lcp = sd.common_prefixes(data, sa, rank, 50, lane=16)
        for k in range(1, len(raw)):
            a, b = raw[want[k - 1]:], raw[want[k]:]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, 50)


def test_merging_by_binary_search():
    rng = random.Random(6)
    runs = []
    for shard in range(5):
        names = sorted(rng.sample(range(40), 15))
        runs.append(np.array([(f"{n:04d}".encode(), b"c", n if shard else -1) for n in names], sd._ENTRY))
    merged = sd.merge_runs(runs)
    assert merged["window"].tolist() == sorted(x for r in runs for x in r["window"].tolist())


def test_empty_table(spark):
    assert sd.remove_repeats(frame(spark, [], 1)).collect() == []
