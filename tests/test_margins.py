"""SVMs of many rows: the same problem as LinearSVC, no random features kept."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from vigilia.operators import margins as MG
from vigilia.operators import models as MD


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 6))
    y = (x[:, 0] * x[:, 1] + x[:, 2] + 0.5 * rng.normal(size=1200) > 0).astype(float)
    frame = pd.DataFrame({"v": list(x), "y": y, "w": np.where(y > 0, 0.8, 1.3), "fold": np.arange(1200) % 3})
    d = spark.createDataFrame(frame).select(array_to_vector("v").alias("v"), "y", "w", F.col("fold").cast("int").alias("fold")).repartition(2).persist()
    return d, x, frame


def test_fits_reach_linear_svcs_objective(spark, made, monkeypatch):
    d, x, frame = made
    w, b = MD.rff_projection(6, 24)
    monkeypatch.setattr(MG, "BLOCK", 100)
    monkeypatch.setattr(MG, "CHUNK", 64)
    est = LinearSVC(featuresCol="rff", labelCol="y", weightCol="w", maxIter=50, regParam=0.01)
    z, y, u = MD.rff(x, w, b), 2 * frame.y.to_numpy() - 1, frame.w.to_numpy()
    kept = spark.createDataFrame(pd.DataFrame({"z": list(z), "y": frame.y, "w": u, "fold": frame.fold})).select(array_to_vector("z").alias("rff"), "y", "w", "fold").coalesce(1).persist()
    svc, margins = MG.fit(d, est, "v", "y", "w", "fold", 3, w, b)
    blocks = MG.blocks_of(d, "v", "y", "w", "fold").rdd.map(tuple)
    coef, intercept = MG.fit_folds(blocks, w, b, 3, 0.01, 50)
    assert np.abs(svc.coefficients.toArray() - coef[-1]).max() < 1e-9 and abs(svc.intercept - intercept[-1]) < 1e-9
    for k in (0, 3):  # without a fold, and all rows
        rows = (frame.fold != k).to_numpy()
        mean = np.average(z[rows], axis=0, weights=u[rows])
        sd = np.sqrt((u[rows, None] * (z[rows] - mean) ** 2).sum(axis=0) / (u[rows].sum() - (u[rows] ** 2).sum() / u[rows].sum()))
        loss = lambda c, i: np.average(np.maximum(0, 1 - y[rows] * (z[rows] @ c + i)), weights=u[rows]) + 0.005 * ((c * sd) ** 2).sum()  # noqa: B023, E731
        theirs = est.fit(kept.filter(F.col("fold") != k))
        assert loss(coef[k], intercept[k]) < loss(theirs.coefficients.toArray(), theirs.intercept) + 1e-4
    got = margins.toPandas()  # out of fold
    want = np.array([z[i] @ coef[f] + intercept[f] for i, f in enumerate(frame.fold)])
    assert np.abs(np.sort(got.svm_margin) - np.sort(want)).max() < 1e-4 and got.y.sum() == frame.y.sum()
    assert svc.transform(kept).filter("prediction = y").count() > 900


def test_random_features_of_many_rows_are_not_written(spark, made, monkeypatch):
    d, _, frame = made
    cols = [f"c{i}" for i in range(6)]
    from pyspark.ml.functions import vector_to_array
    rows = d.select("y", *[vector_to_array("v")[i].alias(c) for i, c in enumerate(cols)])
    spec = MD.ModelSpec("svm", "rff_svm", dict(n_components=24, max_iter=12, folds=2))
    monkeypatch.setattr(MG, "SVM_ROWS", 1)
    monkeypatch.setattr(MD, "checkpoint", lambda d: pytest.fail("random features are written"))
    monkeypatch.setattr(LinearSVC, "_fit", lambda *a: pytest.fail("a fit that keeps random features"))
    got = MD.score(MD.fit(rows, spec, cols, "y"), rows, cols, keep=("y",)).toPandas()
    assert len(got) == 1200 and ((got.p > 0.5) == (got.y > 0.5)).mean() > 0.75
