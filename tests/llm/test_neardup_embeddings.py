import numpy as np
from skewline.llm import neardup_embeddings as ne
from skewline.llm.components import least_reachable


def brute(rows, threshold=0.98):
    """n_links and component of every (vec_id) of unique rows, by all pairs."""
    ok = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        ok[i] = (np.array(v, float), label)
    links = {i: set() for i, *_ in rows}
    for i, (x, a) in ok.items():
        for j, (y, b) in ok.items():
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), None if i is None else min(seen))
    return out


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    x = np.repeat(base, 5, 0) + rng.normal(size=(200, 16)) * rng.choice([0.05, 0.2, 0.3], size=(200, 1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if u[i] @ u[j] >= 0.98}
    i, j, computed = ne.linked_pairs(x, None, 0.98)
    assert set(zip(i.tolist(), j.tolist())) == want and want and computed < 200 * 199 / 8
    i, j, _ = ne.linked_pairs(x[:90], x[90:], 0.98)
    assert {(a, b + 90) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in want if a < 90 <= b}


def test_against_all_pairs_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        v = rng.normal(size=8)
        if i % 3:
            v = np.array(rows[int(rng.integers(0, i))][1]) * rng.choice([1, 2.5]) + rng.normal(size=8) * rng.choice([0, 0.05, 0.2])
        rows.append((i, v.tolist(), int(rng.choice([0, 0, 0, 1]))))
    df = spark.createDataFrame(rows + rows[:20], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ne.near_duplicates(df, block=16).collect()}
    assert got == brute(rows)


def test_hot_group_of_near_copies_and_copies(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=12)
    rows = [(i, (base + rng.normal(size=12) * 0.001).tolist(), 7) for i in range(300)] + [(i, base.tolist(), 7) for i in range(300, 500)]
    got = ne.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=64).collect()
    assert len(got) == 500 and {(r.n_links, r.component_id, r.kept) for r in got} == {(499, 0, r.kept) for r in got}
    assert [r.vec_id for r in got if r.kept] == [0]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [1.0, nan], 1), (5, [inf, 1.0], 1), (6, [1.0, 2.0], None),
            (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1), (9, [1.0, 2.0, 0.0], 1), (10, [1e300, 2e300], 1), (11, [-0.0, 1.0], 2), (12, [0.0, 1.0], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, [1.0, 2.0], 1, "x")],
                               "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ne.near_duplicates(df).collect()}
    want = brute([r for r in rows if r[0] != 10])
    want[7], want[8], want[10] = (2, 7), (2, 7), (2, 7)
    want[None] = (0, None)
    assert got == want
    assert ne.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 180)] + [(500, 400), (400, 450)]
    got = {r.id: r.component for r in least_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{j: 100 for j in range(100, 180)}, 500: 400, 400: 400, 450: 400}
