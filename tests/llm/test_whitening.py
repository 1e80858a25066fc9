from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from skewline.llm import whitening as wh


def brute(vectors, components=32):
    """Covariance by exact fractions, whitened up to signs, deviations."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    t = [[n * r[i] - s[i] for i in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in t), n ** 3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, [sum(c * c for c in r) for r in t], (np.array(t, float) / n) @ u / np.sqrt(e), e / np.trace(v)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n string")


def test_against_fractions(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3).astype(np.float32).tolist()
    vectors[7] = vectors[8]
    bad = [(900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [float("nan")] + [1.0] * 5), (904, [float("inf")] + [1.0] * 5)]
    rows = [(i, v, "clash") for i, v in enumerate(vectors)] + [(i, v, "x") for i, v in bad]
    got = wh.whiten(frame(spark, rows).repartition(5)).collect()
    n, deviation, whitened, explained = brute(vectors)
    assert len(got) == 300 * 6 and {r.n for r in got} == {n}
    table = np.zeros((300, 6))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert int(r.deviation) == deviation[r.vec_id] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
    sign = np.sign((table * whitened).sum(0))
    assert np.allclose(table * sign, whitened, atol=1e-8)
    assert np.allclose(table.T @ table / n, np.eye(6), atol=1e-9)


def test_first_components_only_and_hot_copies(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 40)).tolist() + [[0.25] * 40] * 60
    got = wh.whiten(frame(spark, [(i if i % 3 else None, v, "") for i, v in enumerate(vectors)], "double").repartition(7)).collect()
    assert len(got) == 120 * 32 and {r.component for r in got} == set(range(1, 33))
    assert sum(r.vec_id is None for r in got) == 40 * 32
    by = {c: next(r.explained for r in got if r.component == c) for c in range(1, 33)}
    assert all(by[c] >= by[c + 1] for c in range(1, 32))
    assert by[1] == pytest.approx(brute(vectors)[3][0], rel=1e-9)


def test_degenerate_tables(spark):
    assert wh.whiten(frame(spark, [])).collect() == []
    assert wh.whiten(frame(spark, [(1, None, ""), (2, [], "")])).collect() == []
    assert wh.whiten(frame(spark, [(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")])).collect() == []
    got = wh.whiten(frame(spark, [(1, [1.0, 0.0], ""), (2, [2.0, 0.0], ""), (3, [3.0, 0.0], "")])).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(1, 1), (2, 1), (3, 1)]
    mixed = [(i, [float(i), float(i * i)], "") for i in range(6)] + [(10 + i, [float(i % 2)], "") for i in range(4)]
    got = wh.whiten(frame(spark, mixed)).collect()
    assert sorted({(r.dim, r.n) for r in got}) == [(1, 4), (2, 6)] and max(r.identity_error for r in got) < 1e-9


def test_large_values_stay_exact(spark):
    rows = [(i, [float(c) for c in v], "") for i, v in enumerate([(2**40, 1), (-2**40, 5), (3, -7), (2**60, 2), (12345.5, 3)])]
    got = wh.whiten(frame(spark, rows, "double")).withColumn("short", wh.as_long(F.col("deviation"))).collect()
    clipped = [[min(max(c, -2.0**40), 2.0**40) for c in v] for _, v, _ in rows]
    _, deviation, _, explained = brute(clipped)
    assert all(int(r.deviation) == deviation[r.vec_id] for r in got) and got[0].explained == pytest.approx(explained[0], rel=1e-4)
    assert all(r.short is None if r.deviation > 2**63 else r.short == r.deviation for r in got)
    assert wh.square_sums(np.array([[2**40, 3]])).tolist() == [2**80, (2**40 + 3)**2, 9]
