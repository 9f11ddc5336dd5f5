"""Training, scoring and persistence with Spark ML.

Models are ``Pipeline``s: exact median imputation fitted on the training split (I3),
vector assembly in a fixed feature order (B16), then the estimator. Class
balance is a weight column (I8), never row duplication. Scores are
``vector_to_array(probability)[1]`` (K1). Every estimator trains on executors.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression,
                                       LogisticRegressionModel, RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions import constants as K
from ..session import checkpoint
from . import margins as MG
from . import profile as P
from . import split as SP
from . import trees as TR

# ---------------------------------------------------------------- FIXED VALUES
# Estimator configurations of the reference scripts (trees, depth, leaf size, subsampling).
RF_CONFIGS = {
    "rf_main": dict(numTrees=300, maxDepth=15, minInstancesPerNode=2, featureSubsetStrategy="sqrt", balanced=True),
    # leaf size 5 stands for the script's split size 10, which Spark ML's trees do not have
    "rf_compare": dict(numTrees=200, maxDepth=10, minInstancesPerNode=5, featureSubsetStrategy="sqrt", balanced=True),
    "rf_and_xgb": dict(numTrees=300, maxDepth=15, minInstancesPerNode=10, featureSubsetStrategy="sqrt", balanced=True),
    "rf_notebook": dict(numTrees=800, maxDepth=25, minInstancesPerNode=1, featureSubsetStrategy="log2", balanced=True),
}
GBT_CONFIGS = {
    "gbt_notebook": dict(maxIter=400, maxDepth=8, stepSize=0.1, subsamplingRate=1.0, featureSubsetStrategy="all"),
    "gbt_script": dict(maxIter=300, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8"),
    "gbt_compare": dict(maxIter=200, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8"),
}
# ------------------------------------------------------------ end FIXED VALUES


@dataclass
class ModelSpec:
    name: str
    kind: str  # rf | gbt | lr | rff_svm
    params: dict = field(default_factory=dict)
    balanced: bool = True


ROWS_A_PARTITION = 1 << 14  # rows that are worth a task of their own in every short job of a linear fit


def tree_rows(d: DataFrame) -> DataFrame:
    """``d`` in at most two partitions a core: trees shuffle the statistics of every open node from each partition in full,
    however few its rows. Their draws of rows are seeded by partition, so fewer partitions stay as they are."""
    return d.coalesce(2 * d.sparkSession.sparkContext.defaultParallelism)


def feature_frame(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Cast the feature columns to double (one-hot and counts included)."""
    return df.withColumns({c: F.col(c).cast("double") for c in features})


class MedianImputer(Estimator):
    """Median imputation, fitted with the exact medians of :func:`profile.quantile_values`; NULL and NaN are missing.

    The fitted stage is a ``SQLTransformer`` (``<column>__imp`` per column), saved and loaded with its pipeline. A column
    without values stays NULL."""

    def __init__(self, cols: Sequence[str]):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        medians = P.quantile_values(dataset, self.cols)
        fill = [f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), CAST({medians[c]!r} AS DOUBLE)) AS `{c}__imp`" if c in medians
                else f"nanvl(CAST(`{c}` AS DOUBLE), NULL) AS `{c}__imp`" for c in self.cols]
        return SQLTransformer(statement=f"SELECT *, {', '.join(fill)} FROM __THIS__")


def _imputer(features: Sequence[str]) -> MedianImputer:
    return MedianImputer(features)


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"{c}__imp" for c in features], outputCol="features", handleInvalid="keep")


def rff_projection(n_in: int, n_components: int, gamma: float | None = None, seed: int = 42):
    """Random Fourier features for an RBF kernel: W ~ N(0, 2 gamma), b ~ U(0, 2 pi), fixed by the seed."""
    gamma = gamma or 1.0 / n_in
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2 * gamma), size=(n_components, n_in)), rng.uniform(0, 2 * np.pi, size=n_components)


def add_rff(df: DataFrame, vec_col: str, n_in: int, n_components: int, out: str = "rff", seed: int = 42) -> DataFrame:
    """z(x) = sqrt(2/D) cos(W x + b) of a vector column: one matrix product per Arrow batch."""
    from pyspark.ml.functions import array_to_vector
    w, b = rff_projection(n_in, n_components, seed=seed)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(rff(np.vstack(x.to_numpy()) if len(x) else np.zeros((0, n_in)), w, b)))

    return df.withColumn(out, array_to_vector(project(vector_to_array(vec_col))))


def rff(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Features whose inner products approach the kernel exp(-gamma |x - y|^2), with an error of about sqrt(1 / components)."""
    return np.sqrt(2.0 / len(b)) * np.cos(x @ w.T + b)


class RffSvmModel:  # saved part by part, see save / load
    """RBF-kernel SVM with probabilities, re-aimed for scale: scaler -> random Fourier
    features -> linear SVM -> logistic calibration of out-of-fold margins (Platt scaling)."""

    def __init__(self, prep: PipelineModel, svc, calib, n_in: int, n_components: int):
        self.prep, self.svc, self.calib, self.n_in, self.n_components = prep, svc, calib, n_in, n_components

    def transform(self, df: DataFrame) -> DataFrame:
        d = add_rff(self.prep.transform(df), "scaled_vec", self.n_in, self.n_components)
        d = self.svc.transform(d).withColumn("svm_margin", vector_to_array("svm_raw")[1])
        d = VectorAssembler(inputCols=["svm_margin"], outputCol="margin_vec").transform(d)
        return self.calib.transform(d)


FOLDS = 5  # of the calibration, as in libsvm's probability estimates
RFF_COMPONENTS = 256


def svm_fold(row: Sequence[str], folds: int = FOLDS) -> Column:
    """Fold of a row by the hash of its columns: equal rows share a fold."""
    return F.pmod(F.xxhash64(*row), F.lit(folds)).cast("int")


def fit_rff_svm(d: DataFrame, features: Sequence[str], label: str, weight: str | None, n_components: int = RFF_COMPONENTS,
                reg: float = 0.01, max_iter: int = 50, folds: int = FOLDS) -> RffSvmModel:
    """The SVM that scores learns from all rows; its margins are calibrated on margins out of fold: each fold's rows are
    scored by an SVM that has not seen them, and one logistic fit maps these margins to probabilities."""
    prep = Pipeline(stages=[_imputer(features), _assembler(features),
                            StandardScaler(inputCol="features", outputCol="scaled_vec", withMean=True, withStd=True)]).fit(d)
    scaled = prep.transform(d.withColumn("svm_fold", svm_fold(features, folds)))
    est = LinearSVC(featuresCol="rff", labelCol=label, maxIter=max_iter, regParam=reg, rawPredictionCol="svm_raw",
                    predictionCol="svm_pred", **({"weightCol": weight} if weight else {}))
    platt = lambda m: LogisticRegression(featuresCol="margin_vec", labelCol=label, maxIter=50).fit(
        VectorAssembler(inputCols=["svm_margin"], outputCol="margin_vec").transform(m))
    if d.count() >= MG.SVM_ROWS and {r[0] for r in d.select(label).distinct().limit(3).collect()} == {0.0, 1.0}:
        svc, m = MG.fit(scaled, est, "scaled_vec", label, weight, "svm_fold", folds, *rff_projection(len(features), n_components))
        m = m.persist(StorageLevel.MEMORY_AND_DISK)  # 16 bytes a row
        try:
            return RffSvmModel(prep, svc, platt(m), len(features), n_components)
        finally:
            m.unpersist()
    z = add_rff(scaled, "scaled_vec", len(features), n_components)
    # read by every fit; a fit is some 100 short jobs, whose tasks would each carry the whole plan behind the rows
    z = checkpoint(z.select(label, *([weight] if weight else []), "svm_fold", "rff"))
    parts = max(1, -(-z.count() // ROWS_A_PARTITION))
    z = z.coalesce(parts)
    m = out_of_fold_margins(z, est, folds).coalesce(parts)
    calib = platt(m)
    return RffSvmModel(prep, est.fit(z), calib, len(features), n_components)


def out_of_fold_margins(z: DataFrame, est: LinearSVC, folds: int = FOLDS, fold: str = "svm_fold") -> DataFrame:
    """``z`` with ``svm_margin`` from the model fitted on the other folds' rows."""
    parts = [est.fit(z.filter(F.col(fold) != k)).transform(z.filter(F.col(fold) == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("svm_margin", vector_to_array("svm_raw")[1])


def patient_folds(patient: str | Column, folds: int) -> Column:
    """Fold of a patient by a seeded hash: all hours of a patient share it, NULL is a patient."""
    return F.pmod(F.coalesce(SP.id_hash(patient, 69621, 7, 10009), F.lit(0)), F.lit(folds)).cast("int")


def grouped_grid_search(train: DataFrame, grid: Sequence[dict], features: Sequence[str], label: str, group: str,
                        folds: int = 3) -> DataFrame:
    """Mean validation AUC of each forest of ``grid`` by cross-validation whose folds keep a ``group`` together."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    data = feature_frame(train, features).withColumns({label: F.col(label).cast("double"), "fold": patient_folds(group, folds)})
    data = SP.with_class_weight(data, label, "class_weight").select(*features, label, "class_weight", "fold")
    evaluator = BinaryClassificationEvaluator(labelCol=label)
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="class_weight", seed=42)
    maps = [{forest.getParam(k): v for k, v in params.items() if k != "balanced"} for params in grid]
    found = []  # per fold the AUC of each forest
    for k in range(folds):
        learn, held = (data.filter(c).persist(StorageLevel.MEMORY_AND_DISK) for c in (F.col("fold") != k, F.col("fold") == k))
        prep = Pipeline(stages=[_imputer(features), _assembler(features)]).fit(learn)  # the same for every forest
        x, y = tree_rows(prep.transform(learn)), prep.transform(held)
        fit_one = inheritable_thread_target(train.sparkSession)(lambda m: evaluator.evaluate(TR.Trees(forest.copy(m)).fit(x).transform(y)))
        with ThreadPool(2) as pool:
            found.append(pool.map(fit_one, maps, chunksize=1))
        learn.unpersist()
        held.unpersist()
    aucs = np.mean(found, axis=0)
    rows = [(p["numTrees"], p["maxDepth"], p["minInstancesPerNode"], float(m)) for p, m in zip(grid, aucs)]
    return train.sparkSession.createDataFrame(rows, "num_trees int, max_depth int, min_instances int, cv_auc double")


def build_pipeline(spec: ModelSpec, features: Sequence[str], label: str, weight: str | None) -> Pipeline:
    stages = [_imputer(features), _assembler(features)]
    p = dict(spec.params)
    p.pop("balanced", None)
    common = dict(featuresCol="features", labelCol=label)
    if spec.kind == "rf":
        est = RandomForestClassifier(seed=42, weightCol=weight, **common, **p) if weight else \
            RandomForestClassifier(seed=42, **common, **p)
        stages.append(TR.Trees(est))
    elif spec.kind == "gbt":
        kw = dict(seed=42, **common, **p)
        stages.append(TR.Trees(GBTClassifier(weightCol=weight, **kw) if weight else GBTClassifier(**kw)))
    elif spec.kind == "lr":
        kw = dict(maxIter=p.pop("maxIter", 2000), **common, **p)
        stages += [StandardScaler(inputCol="features", outputCol="scaled_vec", withMean=True, withStd=True)]
        kw["featuresCol"] = "scaled_vec"
        stages.append(LogisticRegression(weightCol=weight, **kw) if weight else LogisticRegression(**kw))
    else:
        raise ValueError(spec.kind)
    return Pipeline(stages=stages)


def fit(train: DataFrame, spec: ModelSpec, features: Sequence[str], label: str) -> PipelineModel:
    """Fit one pipeline; balanced class weights as a column when ``spec.balanced``."""
    d = feature_frame(train, features).withColumn(label, F.col(label).cast("double"))
    weight = None
    if spec.balanced:
        d = SP.with_class_weight(d, label, "class_weight")
        weight = "class_weight"
    if spec.kind == "rff_svm":
        return fit_rff_svm(d, features, label, weight, **spec.params)
    return build_pipeline(spec, features, label, weight).fit(tree_rows(d) if spec.kind in ("rf", "gbt") else d)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], p_col: str = "p",
          keep: Sequence[str] = ("obs_id",)) -> DataFrame:
    """K1: batch scoring; probability of class 1 as a double column."""
    out = model.transform(feature_frame(df, features))
    return out.select(*keep, vector_to_array("probability")[1].alias(p_col))


def feature_importance(model: PipelineModel, features: Sequence[str], top: int | None = 15) -> DataFrame:
    """M4 + F1: tree-ensemble importances with display names, sorted (a bounded, per-feature table)."""
    est = model.stages[-1]
    imp = est.featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(f, K.FEATURE_NAMES.get(f, f), float(v)) for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "feature string, display_name string, importance double")
    df = df.orderBy(F.col("importance").desc(), F.col("feature"))
    return df.limit(top) if top else df


def save(model: PipelineModel, path: str, features: Sequence[str], threshold: float, extra: dict | None = None) -> None:
    """Model with ``write().overwrite()``, metadata (feature list, threshold) as a one-row Parquet."""
    spark = __import__("pyspark").sql.SparkSession.getActiveSession()
    meta = {"features": list(features), "threshold": float(threshold), **(extra or {})}
    if isinstance(model, RffSvmModel):
        for part in ("prep", "svc", "calib"):
            getattr(model, part).write().overwrite().save(f"{path}/{part}")
        meta |= {"kind": "rff_svm", "n_in": model.n_in, "n_components": model.n_components}
    else:
        model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")


def load(path: str) -> tuple[PipelineModel, dict]:
    spark = __import__("pyspark").sql.SparkSession.getActiveSession()
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    if meta.get("kind") == "rff_svm":
        parts = [cls.load(f"{path}/{part}") for cls, part in ((PipelineModel, "prep"), (LinearSVCModel, "svc"), (LogisticRegressionModel, "calib"))]
        return RffSvmModel(*parts, meta["n_in"], meta["n_components"]), meta
    return PipelineModel.load(f"{path}/model"), meta
