"""Shapley values of boosted trees (A19, M6): what each feature adds to a row's log-odds.

A fitted booster is a node table.  Along the path to a leaf a feature is either followed by
the row (its values lie in the path's interval) or unknown, in which case a row goes on with
the share of training rows that did.  The Shapley value of a feature in a leaf is the mean
change it makes over all orders in which the path's features become known; as a row
either follows a feature or not, these values form one small table a leaf, worked out once
with the model, and a row only looks them up.  Contributions and the base (the mean of the
leaves by training rows) sum to the booster's log-odds.

The node table and its leaf tables have the size of the model, not of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import accumulate
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.session import shared_path

# A path has at most this many features: its table has two to that power rows.
MAX_PATH = 12
ROWS_AT_ONCE = 256


def node_table(model: GBTClassificationModel, first: int = 0) -> DataFrame:
    """One row per node: tree (from ``first`` on), its weight, node, children (-1 at a leaf), feature, threshold
    (smaller or equal goes left), value and training rows."""
    spark = SparkSession.builder.getOrCreate()
    path = shared_path(spark, "booster")
    model.write().overwrite().save(path)
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.treeWeights)], "treeID int, weight double")
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").join(weights, "treeID").select(
        (F.col("treeID") + first).alias("tree"), "weight", n["id"].alias("node"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
        n["split"]["numCategories"].alias("categories"), n["prediction"].alias("value"), n["rawCount"].alias("rows"))


@dataclass(frozen=True)
class Leaves:
    """Leaves whose paths have ``m`` distinct features, as arrays: a row of ``table`` holds the m
    Shapley values of a leaf for one pattern of followed features."""

    feature: np.ndarray  # (leaves, m)
    above: np.ndarray  # (leaves, m): a row follows if above < x <= upto
    upto: np.ndarray
    table: np.ndarray  # (leaves, 2 ** m, m)


@dataclass(frozen=True)
class Explainer:
    n_features: int
    base: float
    leaves: list[Leaves]

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): Shapley values of every row."""
        out = np.zeros((len(x), self.n_features))
        for at in range(0, len(x), ROWS_AT_ONCE):
            part = x[at:at + ROWS_AT_ONCE]
            rows = np.arange(len(part))[:, None, None]
            flat = np.zeros(len(part) * self.n_features)
            for g in self.leaves:
                value = part[:, g.feature]
                pattern = ((value > g.above) & (value <= g.upto)) @ (1 << np.arange(g.feature.shape[1]))
                phi = g.table[np.arange(len(g.table)), pattern]
                flat += np.bincount((rows * self.n_features + g.feature).ravel(), phi.ravel(), len(flat))
            out[at:at + len(part)] = flat.reshape(len(part), -1)
        return out


def shapley_tables(value: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """(leaves, 2 ** m, m) Shapley values of leaves with ``value`` whose features, where unknown, let the
    shares ``unknown`` (leaves, m) of the rows pass."""
    leaves, m = unknown.shape
    follows = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    out = np.zeros((leaves, 1 << m, m))
    for j in range(m):
        # ways[s]: sum over the sets of s other known features of the share of rows that passes.
        ways = np.zeros((leaves, 1 << m, m))
        ways[:, :, 0] = 1
        for k in range(m):
            if k != j:
                known = ways[:, :, :-1] * follows[None, :, k, None]
                ways *= unknown[:, None, k, None]
                ways[:, :, 1:] += known
        order = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
        out[:, :, j] = value[:, None] * (follows[None, :, j] - unknown[:, None, j]) * (ways @ order)
    return out


def explainer(nodes: list, n_features: int, scale: float = 1.0) -> Explainer:
    """From rows of ``node_table`` (of one or more boosters); ``scale`` multiplies every leaf."""
    trees: dict[int, dict[int, object]] = {}
    for r in nodes:
        trees.setdefault(r.tree, {})[r.node] = r
    base, paths = 0.0, {}
    for tree in trees.values():
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            node = tree[at]
            if node.left < 0:
                leaf = scale * node.weight * node.value
                base += leaf * node.rows / tree[0].rows
                if path:
                    paths.setdefault(len(path), []).append((leaf, path))
                continue
            if node.categories >= 0:
                raise ValueError("contributions are defined for continuous splits")
            for child, left in ((node.left, True), (node.right, False)):
                above, upto, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
                if left:
                    upto = min(upto, node.threshold)
                else:
                    above = max(above, node.threshold)
                todo.append((child, {**path, node.feature: (above, upto, share * tree[child].rows / node.rows)}))
    if paths and max(paths) > MAX_PATH:
        raise ValueError(f"a path has more than {MAX_PATH} features")
    groups = []
    for m, leaves in sorted(paths.items()):
        feature = np.array([list(p) for _, p in leaves])
        above, upto, share = (np.array([[v[i] for v in p.values()] for _, p in leaves]) for i in range(3))
        groups.append(Leaves(feature, above, upto, shapley_tables(np.array([v for v, _ in leaves]), share)))
    return Explainer(n_features, base, groups)


def booster_explainer(boosters: list[GBTClassificationModel], n_features: int) -> Explainer:
    """Of the mean log-odds of some boosters.  A booster's log-odds are twice its margin."""
    first = [0, *accumulate(len(b.treeWeights) for b in boosters)]
    with ThreadPoolExecutor(max_workers=len(boosters)) as pool:
        tables = list(pool.map(lambda b, at: node_table(b, at).collect(), boosters, first))  # bounded by the model's size
    nodes = [r for table in tables for r in table]
    return explainer(nodes, n_features, 2.0 / len(boosters))


def contributions(model: Explainer, features: list[Column]) -> Column:
    """array<double> of the Shapley values of a row's features; a NULL feature counts as 0, as in
    training.  Rows travel in Arrow batches."""

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, model.n_features))
            yield pd.Series(list(model.contributions(x)))

    return values(F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in features]))
