"""Queries: Spark ML training, scoring, importance, SHAP (J1-J6, K1, A6, M4, M5). Rows-only checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import explain as X
from ..operators import models as MD
from ..operators import treeshap as TS
from ..session import scratch_path
from . import train as TR
from .registry import query

LABEL = "sepsis_label"  # label C is a function of the features, so the fitted models are meaningful


def _spec(name, kind, params):
    return MD.ModelSpec(name, kind, params)


RF = _spec("random_forest", "rf", {k: v for k, v in MD.RF_CONFIGS["rf_compare"].items() if k != "balanced"})
GBT = _spec("gradient_boosting", "gbt", MD.GBT_CONFIGS["gbt_compare"])
LR = _spec("logistic_regression", "lr", dict(maxIter=2000))
SVM = _spec("svm_rbf_rff", "rff_svm", dict(n_components=MD.RFF_COMPONENTS))


def _scores(spark, sf, spec):
    data = TR.labelled_splits(spark, sf, LABEL)
    model = TR.fitted(spark, sf, spec, LABEL, data=data)
    return MD.score(model, data.filter(F.col("split") == "test"), K.F39, keep=("obs_id", LABEL))


@query("j1_random_forest_scores")
def q_j1(spark, sf):
    """Random forest (200 trees, depth 10, balanced weights) trained on train, scores on test."""
    return _scores(spark, sf, RF)


@query("j2_gradient_boosting_scores")
def q_j2(spark, sf):
    """Gradient-boosted trees (200 x depth 6, step .1, subsample .8, features .8) scores on test."""
    return _scores(spark, sf, GBT)


@query("j3_logistic_regression_scores")
def q_j3(spark, sf):
    """Balanced logistic regression (2000 iterations) scores on test."""
    return _scores(spark, sf, LR)


@query("j4_rbf_svm_scores")
def q_j4(spark, sf):
    """RBF-kernel SVM re-aimed (random Fourier features + linear SVM + calibration) scores on test."""
    return _scores(spark, sf, SVM)


@query("j5_model_comparison")
def q_j5(spark, sf):
    """J5 + L8: train four models and compare accuracy, precision, recall, F1, ROC-AUC."""
    return TR.compare_models(spark, sf, LABEL)


@query("j6_end_to_end")
def q_j6(spark, sf):
    """Prepare -> split -> train -> tune threshold on validation -> evaluate on test -> save."""
    path = scratch_path(spark, "rf_end_to_end")
    return TR.end_to_end(spark, sf, LABEL, RF, save_path=path)


@query("k1_a6_saved_model_scoring")
def q_k1(spark, sf):
    """K1 + A6: save the model with its metadata, load it back, score every observation."""
    path = scratch_path(spark, "rf_k1")
    data = TR.labelled_splits(spark, sf, LABEL)
    MD.save(TR.fitted(spark, sf, RF, LABEL, data=data), path, K.F39, 0.5, {"label": LABEL})
    model, meta = MD.load(path)
    s = MD.score(model, data, meta["features"], keep=("obs_id",))
    return s.withColumn("decision", (F.col("p") >= meta["threshold"]).cast("int"))


@query("m4_feature_importance")
def q_m4(spark, sf):
    """M4 + F1: top-15 forest feature importances with display names."""
    return MD.feature_importance(TR.fitted(spark, sf, RF, LABEL), K.F39, 15)


def _explained(spark, sf, spec=RF):
    data = TR.labelled_splits(spark, sf, LABEL)
    return TR.fitted(spark, sf, spec, LABEL, data=data), data


@query("m5_tree_shap")
def q_m5(spark, sf):
    """M5: exact TreeSHAP per observation and feature (base + sum of shap == forest probability)."""
    model, data = _explained(spark, sf)
    return TS.shap_long(model, data, K.F39)


@query("m5_tree_shap_boosted")
def q_m5b(spark, sf):
    """M5 on the boosted trees that score (J2): base + sum of shap == margin of every observation."""
    model, data = _explained(spark, sf, GBT)
    return TS.shap_long(model, data, K.F39)


@query("m6_m7_shap_report")
def q_m67(spark, sf):
    """M6 + M7 on model SHAP values: risk / protective factor texts per observation."""
    model, data = _explained(spark, sf)
    rows = TS.shap_rows(model, data, K.F39)
    risk, prot = X.risk_protective(F.col("factors"), "bedside")
    return rows.select("obs_id", "p", risk.alias("risk_factors"), prot.alias("protective_factors"))
