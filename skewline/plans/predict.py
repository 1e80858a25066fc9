"""Training, storing and applying the full signal model.

A fitted ``SignalModel`` holds the calibrated magnitude and direction ensembles (one booster
and one sigmoid a fold), the IV baseline, the kept and top features, k per ticker and the
direction thresholds.  It is saved under a date stamp and reloaded equal; applying it is one
pass over a features table, without joins.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import (GBTClassificationModel, LogisticRegression, LogisticRegressionModel)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.config import DEFAULT, STAGE_B_FEATURES, STAGE_C_FEATURES, Settings
from skewline.operators import contributions as CT
from skewline.operators import cv
from skewline.operators import stats as ST
from skewline.operators import targets as TG
from skewline.operators import walkforward as WF
from skewline.plans import models as MD
from skewline.plans.signals import score_candidates
from skewline.session import materialize

MIN_TRAINING_ROWS = WF.MIN_TRAINING_ROWS


@dataclass
class Ensemble:
    """Boosters and their sigmoids over a list of features; a probability is their mean."""

    features: list[str]
    pairs: list[tuple[GBTClassificationModel, LogisticRegressionModel]]

    def probability(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the calibrated probability ``out``; NULL features count as 0."""
        keep = df.columns
        filled = df.select("*", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f"_f_{f}") for f in self.features])
        df = VectorAssembler(inputCols=[f"_f_{f}" for f in self.features], outputCol="_x", handleInvalid="keep").transform(filled)
        for i, (booster, sigmoid) in enumerate(self.pairs):
            booster, sigmoid = booster.copy(), sigmoid.copy()
            for model, source, target in ((booster, "_x", f"_b{i}"), (sigmoid, f"_v{i}", f"_s{i}")):
                model.setFeaturesCol(source).setProbabilityCol(target).setRawPredictionCol(f"{target}_r").setPredictionCol(f"{target}_p")
            df = booster.transform(df).withColumn(f"_v{i}", array_to_vector(F.array(vector_to_array(f"_b{i}")[1])))
            df = sigmoid.transform(df)
        mean = sum((vector_to_array(f"_s{i}")[1] for i in range(len(self.pairs))), F.lit(0.0)) / len(self.pairs)
        return df.select(*keep, mean.alias(out))


@dataclass
class SignalModel:
    magnitude: Ensemble
    direction: Ensemble
    baseline: LogisticRegressionModel
    iv_median: float
    top_features: list[str]
    long_threshold: float
    short_threshold: float
    k_by_ticker: DataFrame
    metrics: DataFrame

    def predict(self, features: DataFrame) -> DataFrame:
        """date, ticker, p_magnitude, p_up and iv_baseline_p of every row of a features table."""
        df = self.direction.probability(self.magnitude.probability(features, "p_magnitude"), "p_up")
        df = VectorAssembler(inputCols=["_iv"], outputCol="features").transform(
            df.withColumn("_iv", F.coalesce("iv_atm_30dte", F.lit(self.iv_median))))
        return self.baseline.transform(df).select(*MD.KEY, "p_magnitude", "p_up", vector_to_array("probability")[1].alias("iv_baseline_p"))

    def drivers(self, features: DataFrame, k: int = 3) -> DataFrame:
        """A19 for single rows: the ``k`` features that add most, up or down, to a row's log-odds of a
        large move (mean over the ensemble's boosters): date, ticker, rank, feature, contribution."""
        names = self.magnitude.features
        explain = CT.booster_explainer([b for b, _ in self.magnitude.pairs], len(names))
        phi = CT.contributions(explain, [F.col(f) for f in names])
        entry = F.transform(F.col("_phi"), lambda v, i: F.struct(-F.abs(v), i.alias("at"), v.alias("phi")))
        top = F.slice(F.array_sort(entry), 1, k)
        ranked = features.select(*MD.KEY, phi.alias("_phi")).select(*MD.KEY, F.posexplode(top).alias("_r", "e"))
        return ranked.select(*MD.KEY, (F.col("_r") + 1).alias("rank"),
                             F.element_at(F.array(*[F.lit(f) for f in names]), F.col("e.at") + 1).alias("feature"),
                             F.col("e.phi").alias("contribution"))

    def signals(self, candidates: DataFrame, features: DataFrame, bars_rv: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
        """The model's probabilities, thresholds, k and drivers applied to candidates."""
        wanted = features.join(candidates.select(*MD.KEY), MD.KEY, "left_semi")
        return score_candidates(candidates, self.predict(wanted), bars_rv, self.k_by_ticker, self.long_threshold, self.short_threshold,
                                cfg, self.top_features)


def fit_ensemble(frame: DataFrame, roles: DataFrame, features, label: str, cfg: Settings = DEFAULT) -> tuple[Ensemble, DataFrame]:
    """M4, M5, M9: per fold a booster on its train dates and a sigmoid (Platt's targets) on
    its test-date scores; also the calibrated out-of-fold probabilities (date, ticker,
    label, p, fold).  Folds fit concurrently."""
    data = MD.packed(MD.design(frame.where(F.col(label).isNotNull()), features, label))

    def fold(i: int):
        train, test = cv.split_frame(data, roles, i)
        booster = MD.fitted(MD.gbt(cfg), train)
        scored = materialize(MD.p1(booster.transform(test)).select(*MD.KEY, "label", "p"), f"fold-{i}")
        if scored.isEmpty():
            return None
        sigmoid = LogisticRegression(regParam=0.0, standardization=False, weightCol="weight", featuresCol="features",
                                     labelCol="label").fit(MD.platt_targets(scored))
        calibrated = sigmoid.transform(scored.withColumn("features", array_to_vector(F.array("p"))).drop("p"))
        return booster, sigmoid, MD.p1(calibrated).select(*MD.KEY, "label", "p", F.lit(i).alias("fold"))

    with ThreadPoolExecutor(max_workers=cfg.cv_n_folds) as pool:
        done = [x for x in pool.map(fold, range(cfg.cv_n_folds)) if x]
    out = done[0][2]
    for _, _, p in done[1:]:
        out = out.unionByName(p)
    return Ensemble(list(features), [(b, s) for b, s, _ in done]), out


def train(frame: DataFrame, cfg: Settings = DEFAULT) -> SignalModel:
    """Fit everything on a training frame (``operators.targets.training_frame``).

    P14: fewer than 200 rows are refused.  M6: the magnitude ensemble uses the features that
    matter in a calm or stressed regime; thresholds come from calibrated out-of-fold scores."""
    n = frame.count()
    if n < MIN_TRAINING_ROWS:
        raise ValueError(f"training needs {MIN_TRAINING_ROWS} rows, got {n}")
    roles = materialize(MD.fold_roles(frame, cfg), "roles")
    data = MD.packed(MD.design(frame, STAGE_B_FEATURES, "y_magnitude"))

    def pruned():
        first = MD.fitted(MD.gbt(cfg), data)
        effects = MD.regime_pruning(frame.sparkSession, first, data, STAGE_B_FEATURES, cfg).where("kept").collect()
        kept = [f for f in STAGE_B_FEATURES if f in {r.feature for r in effects}]
        return kept, *fit_ensemble(frame, roles, kept, "y_magnitude", cfg)

    # The ensembles and the baseline don't depend on each other; their many small jobs share the cluster.
    with ThreadPoolExecutor(max_workers=2) as pool:
        base = pool.submit(MD.iv_baseline, frame, roles, cfg)
        later = pool.submit(fit_ensemble, frame, roles, STAGE_C_FEATURES, "y_direction", cfg)
        kept, magnitude, oof_b = pruned()
        direction, oof_c = later.result()
        base_auc, baseline, _ = base.result()
    q = ST.exact_percentiles(frame, "iv_atm_30dte", [0.5]).first().q
    median = q[0] if q else None
    oof_c = materialize(oof_c, "oof-c")
    th = ST.direction_thresholds(oof_c.select(F.col("p").alias("p_up"), F.col("label").alias("y_direction")), cfg=cfg).first()
    importance = sum(b.featureImportances.toArray() for b, _ in magnitude.pairs)
    top = [kept[i] for i in sorted(range(len(kept)), key=lambda i: (-importance[i], i))[:5]]
    named = [(materialize(ST.auc(oof, "p", "label", ["fold"]), "auc"), name) for oof, name in ((oof_b, "stage_b"), (oof_c, "stage_c"))]
    metrics = base_auc.withColumn("model", F.lit("iv_baseline"))
    for table, name in named:
        metrics = metrics.unionByName(table.withColumn("model", F.lit(name)))
    return SignalModel(magnitude, direction, baseline, float(median or 0.0), top, float(th.long_threshold), float(th.short_threshold),
                       materialize(TG.calibrate_k(frame, cfg), "k"), materialize(metrics, "metrics"))


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Stamp (the first date the model may score) and path of every stored model."""
    index = spark.read.parquet(f"{root}/models/_index").distinct()
    return index.select(F.to_date("stamp", "yyyyMMdd").alias("stamp"), "path")


def walk_forward(spark: SparkSession, root: str, candidates: DataFrame, features: DataFrame, bars_rv: DataFrame,
                 cfg: Settings = DEFAULT) -> DataFrame:
    """M10 over any range of dates: each candidate is scored by the model, k and thresholds of the
    latest stored stamp on or before its date (column ``stamp``); earlier candidates by none.  One pass a
    model, over its own dates only."""
    known = registry(spark, root)
    stamps = [r.stamp for r in known.orderBy("stamp").collect()]  # one row a refit
    dated = candidates.join(WF.model_at(candidates, known, cfg).select("date", "stamp"), "date")
    out = None
    for stamp, after in zip(stamps, [*stamps[1:], None]):
        own = (F.col("date") >= F.lit(stamp)) & (F.lit(True) if after is None else F.col("date") < F.lit(after))
        model = load(spark, root, stamp.strftime("%Y%m%d"))
        part = model.signals(dated.where(own), features.where(own), bars_rv.where(own), cfg)
        out = part if out is None else out.unionByName(part)
    return out


def save(model: SignalModel, spark: SparkSession, root: str, stamp: str) -> str:
    """Everything a later run needs to score, under one stamp."""
    parts = {"baseline": model.baseline}
    for name, e in (("magnitude", model.magnitude), ("direction", model.direction)):
        for i, (booster, sigmoid) in enumerate(e.pairs):
            parts[f"{name}/{i}/booster"], parts[f"{name}/{i}/sigmoid"] = booster, sigmoid
    facts = spark.createDataFrame([(model.magnitude.features, model.direction.features, len(model.magnitude.pairs), len(model.direction.pairs),
                                    model.iv_median, model.top_features, model.long_threshold, model.short_threshold)],
                                  "magnitude array<string>, direction array<string>, n_magnitude int, n_direction int, iv_median double, "
                                  "top_features array<string>, long_threshold double, short_threshold double")
    return MD.save_artifacts(spark, root, stamp, parts, {"facts": facts, "k_by_ticker": model.k_by_ticker, "metrics": model.metrics})


def load(spark: SparkSession, root: str, stamp: str | None = None) -> SignalModel:
    """The model of a stamp, by default the latest (T4)."""
    stamp = stamp or MD.latest_stamp(spark, root)
    if stamp is None:
        raise FileNotFoundError(f"no model under {root}")
    base = f"{root}/models/{stamp}"
    f = spark.read.parquet(f"{base}/facts").first()

    def ensemble(name: str, features, n: int) -> Ensemble:
        with ThreadPoolExecutor(max_workers=max(n, 1)) as pool:
            return Ensemble(list(features), list(pool.map(lambda i: (GBTClassificationModel.load(f"{base}/{name}/{i}/booster"),
                                                                     LogisticRegressionModel.load(f"{base}/{name}/{i}/sigmoid")), range(n))))

    return SignalModel(ensemble("magnitude", f.magnitude, f.n_magnitude), ensemble("direction", f.direction, f.n_direction),
                       LogisticRegressionModel.load(f"{base}/baseline"), f.iv_median, list(f.top_features), f.long_threshold,
                       f.short_threshold, spark.read.parquet(f"{base}/k_by_ticker"), spark.read.parquet(f"{base}/metrics"))
