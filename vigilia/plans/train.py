"""Training jobs: model comparison loop (J5) and the end-to-end job."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions import constants as K
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import split as SP
from ..session import checkpoint
from ..sources import tables as T
from . import prepare as PR

COMPARE_SPECS = [
    MD.ModelSpec("logistic_regression", "lr", dict(maxIter=2000)),
    MD.ModelSpec("svm_rbf_rff", "rff_svm", dict(n_components=MD.RFF_COMPONENTS)),
    MD.ModelSpec("random_forest", "rf", {k: v for k, v in MD.RF_CONFIGS["rf_compare"].items() if k != "balanced"}),
    MD.ModelSpec("gradient_boosting", "gbt", MD.GBT_CONFIGS["gbt_compare"]),
]

_MODEL_CACHE: dict = {}


def labelled_splits(spark, sf_dir: str, label: str = "sepsis_next_6h") -> DataFrame:
    """Prepared table (F39 + labels A and C) with the exact stratified 70/15/15 split column."""
    v = T.vitals(spark, sf_dir)
    d = L.label_sirs_organ(PR.prepared_table(v, drop_leakage=False))
    d = d.withColumn("_h", SP.id_hash("obs_id"))
    return SP.stratified_split(d, label, ["_h", "obs_id"]).drop("_h")


def training_rows(data: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The training split, only the columns that a fit reads, written once for the fit's many passes (medians, splits, points).

    A checkpoint keeps the rows' partitions, which seed the trees' draws; the planner may choose others for a cached table."""
    return checkpoint(data.filter(F.col("split") == "train").select(*dict.fromkeys([*features, label])))


def fitted(spark, sf_dir: str, spec: MD.ModelSpec, label: str, features: Sequence[str] = K.F39, data: DataFrame | None = None,
           rows: DataFrame | None = None):
    """Fit once per (session, files, spec, label, features) in this process; later queries reuse the model.

    ``data``: what labelled_splits gives, ``rows``: what training_rows gives, where the caller has them."""
    files = tuple(sorted(T.table(spark, sf_dir, "events").inputFiles()))  # new files mean a new fit
    key = (spark.sparkContext.applicationId, files, spec.name, spec.kind, repr(sorted(spec.params.items())), spec.balanced, label, tuple(features))
    if key not in _MODEL_CACHE:
        if rows is None:
            rows = training_rows(labelled_splits(spark, sf_dir, label) if data is None else data, features, label)
        _MODEL_CACHE[key] = MD.fit(rows, spec, features, label)
    return _MODEL_CACHE[key]


def compare_models(spark, sf_dir: str, label: str = "sepsis_label", specs=COMPARE_SPECS,
                   features: Sequence[str] = K.F39) -> DataFrame:
    """J5 + G4 + L8: train each model on the training split, evaluate on the test split, stack the rows.

    Boosted trees and linear fits are hundreds of short jobs one after another, so two models are fitted side by side, those
    with most jobs first; all read the same kept rows. Scores are written once, and one pass of metrics serves all models."""
    data = labelled_splits(spark, sf_dir, label)
    rows = training_rows(data, features, label)
    test = data.filter(F.col("split") == "test").select(*dict.fromkeys([*features, label])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit_one = inheritable_thread_target(spark)(lambda spec: fitted(spark, sf_dir, spec, label, features, rows=rows))
        order = sorted(specs, key=lambda spec: ("gbt", "rff_svm", "lr", "rf").index(spec.kind))
        with ThreadPool(2) as pool:
            models = dict(zip([spec.name for spec in order], pool.map(fit_one, order, chunksize=1)))
        scores = None
        for spec in specs:
            s = MD.score(models[spec.name], test, features, keep=(label,)).select(F.lit(spec.name).alias("model"), F.col(label).alias("y"), "p")
            scores = s if scores is None else scores.unionByName(s)
        scores = checkpoint(scores)
    finally:
        test.unpersist()
    rt = M.rates(M.confusion(scores, ["model"])).select("model", "accuracy", "precision", "recall", "f1")
    return rt.join(M.roc_auc(M.score_curve(scores, ["model"]), ["model"]), on="model")


def end_to_end(spark, sf_dir: str, label: str = "sepsis_label", spec: MD.ModelSpec | None = None,
               grid: str = "g30_59_by1", save_path: str | None = None, features: Sequence[str] = K.F39) -> DataFrame:
    """Prepare -> stratified split -> train -> threshold search on validation -> test metrics -> (save).

    The searched threshold is used (no hard-coded override); validation, not test, picks it. Both splits are scored once.
    """
    spec = spec or MD.ModelSpec("random_forest", "rf",
                                {k: v for k, v in MD.RF_CONFIGS["rf_compare"].items() if k != "balanced"})
    data = labelled_splits(spark, sf_dir, label)
    model = fitted(spark, sf_dir, spec, label, features, data=data)
    scores = checkpoint(MD.score(model, data.filter(F.col("split") != "train"), features, keep=("split", label))
                        .select("split", F.lit(spec.name).alias("model"), F.col(label).alias("y"), "p"))
    val, test = (scores.filter(F.col("split") == name).drop("split") for name in ("val", "test"))
    best = M.threshold_search(val, ["model"], {grid: M.GRIDS[grid]}).filter(F.col("metric") == "f1")
    thr = best.select("best_threshold").first()[0]
    curve = M.score_curve(test, ["model"])
    rt = M.rates(M.confusion(test, ["model"], threshold=thr))
    res = rt.join(M.roc_auc(curve, ["model"]), on="model").join(M.average_precision(curve, ["model"]), on="model") \
        .withColumn("threshold", F.lit(float(thr)))
    if save_path:
        MD.save(model, save_path, features, thr, {"label": label, "model": spec.name})
    return res
