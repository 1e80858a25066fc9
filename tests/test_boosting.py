"""Boosters grown inside a task: the nodes are MLlib's, without a job for every level of every tree."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from skewline.config import DEFAULT
from skewline.operators import boosting as BO
from skewline.plans import models as MD

CFG = DEFAULT.with_(gbt_max_iter=12)


def _frame(spark, n, width, seed=1, one_class=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[:, 1] = np.round(x[:, 1])
    x[rng.random(n) < 0.2, 0] = 0
    if width > 4:
        x[:, 3], x[:, 4] = x[:, 2], 0  # a copy, whose splits gain the same, and one without values
    y = np.ones(n) if one_class else (x[:, 0] + rng.normal(size=n) > 0).astype(float)
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).coalesce(1).cache()


def _nodes(spark, model, path):
    model.write().overwrite().save(str(path))
    return {(r.treeID, r.nodeData.id): r.nodeData for r in spark.read.parquet(f"{path}/data").collect()}


@pytest.mark.parametrize("n, width", [(700, 6), (40, 3), (1, 2)])
def test_nodes_equal_those_of_mllib(spark, tmp_path, n, width):
    data = _frame(spark, n, width)
    theirs, own = MD.gbt(CFG).fit(data), MD.fitted(MD.gbt(CFG), data)
    a, b = _nodes(spark, theirs, tmp_path / "a"), _nodes(spark, own, tmp_path / "b")
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k].leftChild, a[k].rightChild, a[k].rawCount, a[k].split) == (b[k].leftChild, b[k].rightChild, b[k].rawCount, b[k].split)
        assert np.allclose([a[k].prediction, a[k].impurity, a[k].gain, *a[k].impurityStats], [b[k].prediction, b[k].impurity, b[k].gain, *b[k].impurityStats], 1e-9, 1e-12)
    assert theirs.treeWeights == own.treeWeights and np.allclose(theirs.featureImportances.toArray(), own.featureImportances.toArray())
    assert {p.name: v for p, v in theirs.extractParamMap().items()} == {p.name: v for p, v in own.extractParamMap().items()}


def test_one_class_predicts_it(spark):
    data = _frame(spark, 60, 3, one_class=True)
    assert MD.fitted(MD.gbt(CFG), data).transform(data).where("prediction <> 1").count() == 0


def test_a_fit_is_a_few_jobs(spark):
    data = _frame(spark, 300, 3)
    data.count()
    spark.sparkContext.setJobGroup("one-fit", "")
    try:
        MD.fitted(MD.gbt(CFG), data)
    finally:
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one-fit")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20  # a job a level and tree were 48


def test_more_rows_and_other_settings_go_to_mllib(spark, monkeypatch):
    data = _frame(spark, 300, 3)
    grown = []
    monkeypatch.setattr(BO, "_stored_model", lambda *a: grown.append(a))
    assert BO.fit(MD.gbt(CFG).setSubsamplingRate(0.5), data).getNumTrees == 12 and not grown
    monkeypatch.setattr(BO, "ROWS_READ_WHOLE", 100)
    assert BO.fit(MD.gbt(CFG).setMaxBins(8), data).getNumTrees == 12 and not grown
    with pytest.raises(Exception, match="(?i)label"):
        BO.fit(MD.gbt(CFG), data.withColumn("label", F.col("label") + 1))
