"""Tree contributions: Shapley values by enumeration, additivity, drivers."""

import itertools
from collections import namedtuple
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from skewline.operators import contributions as CT
from skewline.plans import models as MD

from test_models import CFG, SCHEMA, _rows

Node = namedtuple("Node", "tree weight node left right feature threshold categories value rows")


def random_tree(rng, tree, depth, features):
    nodes = []

    def grow(d, rows):
        at = len(nodes)
        nodes.append(None)
        if d == 0 or rows < 4 or rng.random() < 0.15:
            nodes[at] = Node(tree, 0.7, at, -1, -1, -1, None, -1, float(rng.normal()), rows)
        else:
            own = int(rng.integers(1, rows))
            left, right = grow(d - 1, own), grow(d - 1, rows - own)
            nodes[at] = Node(tree, 0.7, at, left, right, int(rng.integers(features)), float(rng.normal()), -1, 0.0, rows)
        return at

    grow(depth, 400)
    return nodes


def expected_value(tree, x, known):
    """Mean of the leaves over training rows, given the known features of x."""
    def below(at):
        n = tree[at]
        if n.left < 0:
            return n.weight * n.value
        if n.feature in known:
            return below(n.left if x[n.feature] <= n.threshold else n.right)
        return (tree[n.left].rows * below(n.left) + tree[n.right].rows * below(n.right)) / n.rows
    return below(0)


def test_equal_to_enumeration_of_all_subsets():
    rng = np.random.default_rng(1)
    trees = [random_tree(rng, t, 4, 5) for t in range(6)] + [[Node(6, 2.0, 0, -1, -1, -1, None, -1, 1.5, 9)]]
    model = CT.explainer([n for t in trees for n in t], 5, scale=2.0)
    x = rng.normal(size=(40, 5))
    x[0] = [t[0].threshold if t[0].threshold is not None else 0 for t in trees[:5]]
    got = model.contributions(x)
    for row, phi in zip(x, got):
        value = {s: 2.0 * sum(expected_value(t, row, set(s)) for t in trees) for n in range(6) for s in itertools.combinations(range(5), n)}
        assert abs(model.base - value[()]) < 1e-9 and abs(model.base + phi.sum() - value[tuple(range(5))]) < 1e-9
        for j in range(5):
            rest = [k for k in range(5) if k != j]
            want = sum(factorial(n) * factorial(4 - n) / factorial(5) * (value[tuple(sorted((*s, j)))] - value[s])
                       for n in range(5) for s in itertools.combinations(rest, n))
            assert abs(phi[j] - want) < 1e-9


@pytest.fixture(scope="module")
def fitted(spark):
    frame = spark.createDataFrame(_rows(120, 5), SCHEMA)
    names = ["z_iv_minus_ewma_rv", "z_call_put_volume_ratio", "vix_level", "cor1m_level"]
    data = MD.design(frame, names, "y_magnitude").cache()
    return frame, names, data, MD.gbt(CFG).fit(data)


def test_contributions_of_a_booster_sum_to_its_log_odds(spark, fitted):
    frame, names, data, model = fitted
    explain = CT.booster_explainer([model], len(names))
    df = VectorAssembler(inputCols=[f"_{n}" for n in names], outputCol="features").transform(
        frame.select("*", *[F.coalesce(n, F.lit(0.0)).alias(f"_{n}") for n in names]))
    rows = MD.p1(model.transform(df)).select("p", CT.contributions(explain, [F.col(n) for n in names]).alias("phi")).collect()
    assert len(rows) == 600
    for r in rows:
        assert abs(explain.base + sum(r.phi) - np.log(r.p / (1 - r.p))) < 1e-9
    effect = np.abs([r.phi for r in rows]).mean(0)
    assert min(effect[:2]) > 5 * effect[3]


def test_base_is_the_mean_over_training_rows(spark, fitted):
    frame, names, data, model = fitted
    explain = CT.booster_explainer([model, model], len(names))
    x = np.array([r.features.toArray() for r in data.collect()])
    assert abs(explain.contributions(x).mean(0).sum()) < 0.5 and np.isfinite(explain.base)
    one = CT.booster_explainer([model], len(names))
    assert np.allclose(explain.contributions(x[:50]), one.contributions(x[:50])) and abs(one.base - explain.base) < 1e-9


def test_pruning_on_the_log_odds_scale(spark, fitted):
    frame, names, data, model = fitted
    out = {r.feature: r for r in MD.regime_pruning(spark, model, data, names, CFG).collect()}
    x = np.array([r.features.toArray() for r in data.collect()])
    vix = x[:, 2]
    phi = np.abs(CT.booster_explainer([model], len(names)).contributions(x))
    lo, hi = np.quantile(vix, [0.33, 0.67])
    for j, n in enumerate(names):
        assert abs(out[n].calm_effect - phi[vix <= lo, j].mean()) < 1e-9
        assert abs(out[n].stressed_effect - phi[vix >= hi, j].mean()) < 1e-9
        assert out[n].kept == (max(out[n].calm_effect, out[n].stressed_effect) > 0.005)
