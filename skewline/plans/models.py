"""MLlib training and scoring (M3-M9, A6 on out-of-fold scores, S16).

The training frame is small (tickers x sessions) and is written once to the shared
folder before any fit; each CV fold is an independent Spark job, so folds run
concurrently from a driver thread pool.  Metrics use the exact AUC operator.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skewline.config import DEFAULT, Settings
from skewline.operators import boosting
from skewline.operators import contributions as CT
from skewline.operators import cv
from skewline.operators import stats as ST
from skewline.session import materialize
from skewline.sources.tables import exists

KEY = ["date", "ticker"]
# A booster runs a thousand short jobs over its rows: a task should have this many of them.
ROWS_A_TASK = 25_000
MIN_REGIME_ROWS = 10


def design(frame: DataFrame, features, label: str) -> DataFrame:
    """Feature vector (NULL -> 0) and double label."""
    f = list(features)
    df = frame.fillna(0.0, subset=f)
    df = VectorAssembler(inputCols=f, outputCol="features", handleInvalid="keep").transform(df)
    return df.select(*KEY, "features", F.col(label).cast("double").alias("label"), *[c for c in frame.columns
                                                                                     if c in ("vix_level",)])


def packed(data: DataFrame, name: str = "design") -> DataFrame:
    """``data`` stored for fits, in as many parts as its rows fill tasks."""
    return materialize(data.repartition(max(1, -(-data.count() // ROWS_A_TASK))), name)


def gbt(cfg: Settings = DEFAULT) -> GBTClassifier:
    return GBTClassifier(maxIter=cfg.gbt_max_iter, maxDepth=cfg.gbt_max_depth, stepSize=cfg.gbt_step_size,
                         seed=cfg.seed, featuresCol="features", labelCol="label")


def fitted(estimator, train: DataFrame):
    """``estimator`` fitted on ``train``; boosters of few rows grow inside one task."""
    return boosting.fit(estimator, train) if isinstance(estimator, GBTClassifier) else estimator.fit(train)


def p1(df: DataFrame, col: str = "probability") -> DataFrame:
    return df.withColumn("p", vector_to_array(col)[1])


def _fold_job(data: DataFrame, roles: DataFrame, fold: int, estimator, post=None):
    train, test = cv.split_frame(data, roles, fold)
    model = fitted(estimator(train) if callable(estimator) else estimator, train)
    pred = p1(model.transform(test)).select(*KEY, "label", "p", F.lit(fold).alias("fold"))
    if post is not None:
        pred = post(model, train, test, pred).withColumn("fold", F.lit(fold))
    return fold, model, materialize(pred, f"oof-{fold}")


def cross_validate(data: DataFrame, roles: DataFrame, estimator, n_splits: int, post=None, threads: int | None = None):
    """Fit one model per fold on its 'train' dates, score its 'test' dates.  ``estimator``
    may be a function of the fold's training rows.

    Returns (fold models, out-of-fold predictions, per-fold AUC table)."""
    folds = list(range(n_splits))
    threads = threads or n_splits  # the folds wait for the cluster, whatever the driver's cores
    with ThreadPoolExecutor(max_workers=threads) as ex:
        res = list(ex.map(lambda k: _fold_job(data, roles, k, estimator, post), folds))
    models = {k: m for k, m, _ in res}
    oof = res[0][2]
    for _, _, p in res[1:]:
        oof = oof.unionByName(p)
    a = ST.auc(oof, "p", "label", ["fold"])
    return models, oof, a


def fold_roles(frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return cv.purged_folds(cv.fold_ids(frame, cfg.cv_n_folds), cfg)


# --------------------------------------------------------------------------- M3


def iv_baseline(frame: DataFrame, roles: DataFrame, cfg: Settings = DEFAULT, label: str = "y_magnitude"):
    """M3: logistic regression on ATM IV (NULL -> median, P16 exact median), L2 with C = 1
    (regParam = 1 / n of the rows fitted, no standardisation), purged-CV AUC plus a final fit."""
    med = ST.exact_percentiles(frame, "iv_atm_30dte", [0.5]).select(F.col("q")[0]).scalar()
    df = frame.withColumn("iv_atm_30dte", F.coalesce(F.col("iv_atm_30dte"), med))
    data = packed(design(df, ["iv_atm_30dte"], label), "iv-design")

    def ridge(train):
        return LogisticRegression(regParam=1.0 / max(train.count(), 1), elasticNetParam=0.0, standardization=False, maxIter=500,
                                  featuresCol="features", labelCol="label")

    _, oof, a = cross_validate(data, roles, ridge, cfg.cv_n_folds)
    return a, ridge(data).fit(data), oof


# --------------------------------------------------------------------------- M4, M5, M9


def stage_cv(frame: DataFrame, roles: DataFrame, features, label: str, cfg: Settings = DEFAULT):
    data = packed(design(frame, features, label))
    models, oof, a = cross_validate(data, roles, gbt(cfg), cfg.cv_n_folds)
    return data, models, oof, a


def platt_targets(test_pred: DataFrame) -> DataFrame:
    """Platt's soft targets as two weighted rows per example: t+ = (N+ + 1) / (N+ + 2),
    t- = 1 / (N- + 2)."""
    npos = test_pred.select(F.sum("label")).scalar()  # scalar subqueries: counts of one fold's test rows
    nneg = test_pred.select(F.count(F.lit(1))).scalar() - npos
    t = F.when(F.col("label") == 1, (npos + 1) / (npos + 2)).otherwise(F.lit(1.0) / (nneg + 2))
    base = test_pred.select(array_to_vector(F.array("p")).alias("features"), t.alias("_t"))
    return base.select("features", F.lit(1.0).alias("label"), F.col("_t").alias("weight")).unionByName(
        base.select("features", F.lit(0.0).alias("label"), (F.lit(1.0) - F.col("_t")).alias("weight")))


def platt_cv(frame: DataFrame, roles: DataFrame, features, label: str, cfg: Settings = DEFAULT) -> DataFrame:
    """M5 (CalibratedClassifierCV, sigmoid): per fold a booster on the train dates and a
    sigmoid on its test-date scores; the calibrated probability of every row is the
    mean over the folds' (booster, sigmoid) pairs."""
    data = packed(design(frame, features, label))

    def post(model, train, test, pred):
        sig = LogisticRegression(regParam=0.0, standardization=False, weightCol="weight", featuresCol="features",
                                 labelCol="label").fit(platt_targets(pred))
        scored = p1(model.transform(data)).select(*KEY, "label", array_to_vector(F.array("p")).alias("features"))
        cal = p1(sig.transform(scored), "probability")
        return cal.select(*KEY, "label", "p")

    models, allp, _ = cross_validate(data, roles, gbt(cfg), cfg.cv_n_folds, post=post)
    return allp.groupBy(*KEY).agg(F.first("label").alias("label"), F.avg("p").alias("p_calibrated"),
                                  F.count(F.lit(1)).alias("n_models"))


# --------------------------------------------------------------------------- M6, M7


def top_features(model, features, k: int = 5):
    imp = model.featureImportances.toArray().tolist()
    order = sorted(range(len(features)), key=lambda i: (-imp[i], i))[:k]
    return [(r + 1, features[i], float(imp[i])) for r, i in enumerate(order)]


def regime_pruning(spark: SparkSession, model, data: DataFrame, features, cfg: Settings = DEFAULT,
                   threshold: float = 0.005) -> DataFrame:
    """Mean |contribution| to the log-odds per feature within the calm (VIX <= q33) and
    stressed (VIX >= q67) regimes; keep a feature above ``threshold`` in either regime (all
    features if none is).  P14: a regime of ten rows or fewer has no say."""
    f = list(features)
    q = ST.exact_percentiles(data, "vix_level", [0.33, 0.67]).scalar()
    reg = F.when(F.col("vix_level") <= q[0], "calm").when(F.col("vix_level") >= q[1], "stressed")
    explain = CT.booster_explainer([model], len(f))
    rows = data.withColumn("regime", reg).where(F.col("regime").isNotNull()).withColumn("_x", vector_to_array("features"))
    rows = rows.select("regime", CT.contributions(explain, [F.col("_x")[i] for i in range(len(f))]).alias("_phi"))
    eff = (rows.select("regime", F.posexplode("_phi").alias("fi", "phi")).groupBy("fi", "regime")
           .agg(F.when(F.count(F.lit(1)) > MIN_REGIME_ROWS, F.avg(F.abs("phi"))).alias("effect")))
    names = F.element_at(F.array(*[F.lit(x) for x in f]), F.col("fi") + 1)
    piv = eff.groupBy("fi").agg(F.max(F.when(F.col("regime") == "calm", F.col("effect"))).alias("calm_effect"),
                                F.max(F.when(F.col("regime") == "stressed", F.col("effect"))).alias("stressed_effect"))
    piv = piv.withColumn("kept", (F.coalesce("calm_effect", F.lit(0.0)) > threshold)
                         | (F.coalesce("stressed_effect", F.lit(0.0)) > threshold))
    any_kept = piv.select(F.max(F.col("kept").cast("int"))).scalar()
    return piv.select(names.alias("feature"), "calm_effect", "stressed_effect",
                      (F.col("kept") | (F.coalesce(any_kept, F.lit(0)) == 0)).alias("kept"))


# --------------------------------------------------------------------------- S16


SAVED_AT_ONCE = 8


def save_artifacts(spark: SparkSession, root: str, stamp: str, models: dict, tables: dict) -> str:
    """Fitted models and side tables (thresholds, k per ticker, metrics) under one
    date stamp, registered in a stamp index table."""
    base = f"{root}/models/{stamp}"
    with ThreadPoolExecutor(max_workers=SAVED_AT_ONCE) as pool:
        list(pool.map(lambda part: part[1].write().overwrite().save(f"{base}/{part[0]}"), models.items()))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    spark.createDataFrame([(stamp, base)], "stamp string, path string").write.mode("append").parquet(
        f"{root}/models/_index")
    return base


def latest_stamp(spark: SparkSession, root: str):
    """T4: the newest registered model stamp (yyyymmdd strings order as dates)."""
    path = f"{root}/models/_index"
    return None if not exists(spark, path) else spark.read.parquet(path).select(F.max("stamp")).first()[0]
