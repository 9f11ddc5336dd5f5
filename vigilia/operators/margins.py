"""The linear SVMs behind J4 for many rows: all folds' fits from one pass over the rows per step, no random features kept.

A row's random features are 2 kB, those of a table outgrow any disk that the table fits. Here blocks of scaled columns are kept
(4 bytes a number) and the features of some thousand rows are made, used by all fits at once and dropped. A fit minimises what
Spark ML's ``LinearSVC`` does (mean weighted hinge loss and the squared norm of standardised coefficients, free intercept) by
L-BFGS with its line search, limits and tolerance; the fits step together, so a step of all is one job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .trees import spread

SVM_ROWS = 1 << 17  # fewer rows are Spark ML's
BLOCK = 1 << 15  # rows of a block
CHUNK = 1 << 12  # rows whose random features are made together
MEMORY = 10  # steps that L-BFGS remembers


def blocks_of(d: DataFrame, vec: str, label: str, weight: str | None, fold: str) -> DataFrame:
    """(part, k, x, y, w, fold): numbers of the partition and block, and some rows as bytes of float32, int8, float32 and int8."""
    def run(batches):
        number = -1
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, w, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for i in range(0, batch.num_rows, BLOCK):
                s, number = slice(i, i + BLOCK), number + 1
                yield pa.RecordBatch.from_pylist([dict(part=batch.column(4)[0].as_py(), k=number, x=x[s].astype(np.float32).tobytes(), y=np.where(y[s] > 0.5, 1, -1).astype(np.int8).tobytes(),
                                                       w=w[s].astype(np.float32).tobytes(), fold=k[s].astype(np.int8).tobytes())], schema=out)

    out = pa.schema([("part", pa.int32()), ("k", pa.int32()), *((c, pa.binary()) for c in ("x", "y", "w", "fold"))])
    rows = d.select(vector_to_array(vec).alias("x"), F.col(label).cast("double"), (F.col(weight) if weight else F.lit(1.0)).cast("double"), F.col(fold), F.spark_partition_id())
    return rows.mapInArrow(run, "part int, k int, x binary, y binary, w binary, fold binary")


def chunks(block, w: np.ndarray, b: np.ndarray):
    """(random features, -1 or 1, weight, fold) of ``CHUNK`` rows at a time."""
    x, y, weight, fold = (np.frombuffer(c, t) for c, t in zip(block[2:], (np.float32, np.int8, np.float32, np.int8)))
    x, scale = x.reshape(len(y), -1), np.float32(np.sqrt(2.0 / len(b)))
    for i in range(0, len(y), CHUNK):
        s = slice(i, i + CHUNK)
        z = x[s] @ w.T
        z += b
        np.cos(z, out=z)
        z *= scale
        yield z, y[s], weight[s], fold[s]


def fit_folds(blocks, w: np.ndarray, b: np.ndarray, folds: int, reg: float, max_iter: int, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts) of the fits without each fold, and of that of all rows as the last. ``blocks``: RDD of tuples."""
    w, b, fits = w.astype(np.float32), b.astype(np.float32), folds + 1

    def moments(it):
        total = np.zeros((folds, 2 + 2 * len(b)))
        for block in it:
            for z, _, weight, fold in chunks(block, w, b):
                for k in np.unique(fold):
                    u, v = weight[fold == k].astype(float), z[fold == k].astype(float)
                    total[k] += np.concatenate([[u.sum(), (u * u).sum()], u @ v, u @ (v * v)])
        yield total

    by_fold = blocks.mapPartitions(moments).sum()
    total = np.concatenate([by_fold.sum(axis=0) - by_fold, by_fold.sum(axis=0)[None]])
    mass, mean = total[:, 0], total[:, 2:2 + len(b)] / total[:, :1]
    spread = (total[:, 2 + len(b):] - mass[:, None] * mean ** 2) / np.maximum(mass - total[:, 1] / mass, 1e-300)[:, None]
    inverse = np.where(spread > 1e-12, 1 / np.sqrt(np.maximum(spread, 1e-12)), 0.0)

    def losses(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        """Value and gradient at a point (standardised coefficients, intercept) of each fit named."""
        at = np.array(sorted(points))
        scaled = np.stack([points[j][:-1] * inverse[j] for j in at])
        offset = np.array([points[j][-1] for j in at]) - (scaled * mean[at]).sum(axis=1)
        coef, off = scaled.T.astype(np.float32), offset.astype(np.float32)

        def run(it):
            value, push, gradient = np.zeros(len(at)), np.zeros(len(at)), np.zeros((len(at), len(b)))
            for block in it:
                for z, y, weight, fold in chunks(block, w, b):
                    short = 1 - y[:, None] * (z @ coef + off)
                    on = weight[:, None] * ((short > 0) & (fold[:, None] != at))
                    value += (short * on).sum(axis=0, dtype=float)
                    on *= -y[:, None]
                    push += on.sum(axis=0, dtype=float)
                    gradient += on.T @ z
            yield value, push, gradient

        value, push, gradient = map(sum, zip(*blocks.mapPartitions(run).collect()))
        return {j: (value[i] / mass[j] + reg / 2 * (points[j][:-1] ** 2).sum(),
                    np.concatenate([(gradient[i] - push[i] * mean[j]) * inverse[j] / mass[j] + reg * points[j][:-1], [push[i] / mass[j]]])) for i, j in enumerate(at)}

    found = together(losses, [np.zeros(len(b) + 1) for _ in range(fits)], max_iter, tol)
    coef = np.stack([x[:-1] for x in found]) * inverse
    return coef, np.array([x[-1] for x in found]) - (coef * mean).sum(axis=1)


def together(losses: Callable, starts: list[np.ndarray], max_iter: int, tol: float) -> list[np.ndarray]:
    """Minimises several functions; each call of ``losses`` answers the next question of every one that is not done."""
    searches = {j: _search(x, max_iter, tol) for j, x in enumerate(starts)}
    asked, found = {j: next(s) for j, s in searches.items()}, {}
    while asked:
        answers, asked = losses(asked), {}
        for j, answer in answers.items():
            try:
                asked[j] = searches[j].send(answer)
            except StopIteration as done:
                found[j] = done.value
    return [found[j] for j in range(len(starts))]


def _search(x: np.ndarray, max_iter: int, tol: float):
    """L-BFGS as a generator: yields points, is sent (value, gradient), returns the last point."""
    value, gradient = yield x
    steps, values, failed = [], [value], False
    for i in range(max_iter):
        if np.linalg.norm(gradient) <= tol * max(1.0, abs(value)):
            break
        direction = -_inverse_hessian(gradient, steps)
        slope = direction @ gradient
        t, shrink = (0.5 / np.linalg.norm(gradient), 0.1) if not i else (1.0, 0.5)
        if slope >= 0:
            steps, direction, slope, t = [], -gradient, -gradient @ gradient, 0.5 / np.linalg.norm(gradient)
        best = None
        for _ in range(20):
            new = x + t * direction
            v, g = yield new
            low = v <= value + 1e-4 * t * slope
            if low and (best is None or v < best[1]):
                best = new, v, g
            if not low or abs(g @ direction) > 0.9 * abs(slope) and g @ direction > 0:
                t *= shrink
            elif g @ direction < 0.9 * slope:
                t *= 2.1
            else:
                break
        if best is None:  # no lower point along it: once more by the gradient alone
            if failed:
                break
            steps, failed = [], True
            continue
        failed = False
        moved, turned = best[0] - x, best[2] - gradient
        if moved @ turned > 1e-12 * (moved @ moved):
            steps = [*steps, (moved, turned)][-MEMORY:]
        x, value, gradient = best
        values.append(value)
        if len(values) > MEMORY and values[-1 - MEMORY] - value <= tol * max(abs(value), abs(values[-1 - MEMORY])):
            break
    return x


def _inverse_hessian(gradient: np.ndarray, steps: list) -> np.ndarray:
    q, kept = gradient.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(kept)):
        q += (a - (y @ q) / (s @ y)) * s
    return q


def fold_margins(blocks: DataFrame, w: np.ndarray, b: np.ndarray, coef: np.ndarray, intercept: np.ndarray, label: str) -> DataFrame:
    """(label, svm_margin) of every row, by the fit that has not seen its fold."""
    def run(batches):
        for batch in batches:
            for block in zip(*(c.to_pylist() for c in batch.columns)):
                for z, y, _, fold in chunks(block, w, b):
                    margin = np.einsum("ij,ij->i", z, coef.take(fold, axis=0)) + intercept.take(fold)
                    yield pa.RecordBatch.from_arrays([pa.array((y > 0).astype(float)), pa.array(margin)], names=[label, "svm_margin"])

    return blocks.mapInArrow(run, f"`{label}` double, svm_margin double")


def fit(d: DataFrame, est: LinearSVC, vec: str, label: str, weight: str | None, fold: str, folds: int, w: np.ndarray, b: np.ndarray) -> tuple[LinearSVCModel, DataFrame]:
    """The SVM of all rows, and the margins out of fold."""
    table = blocks_of(d, vec, label, weight, fold)
    blocks = spread(table.rdd.map(lambda r: (r.part, r.k, bytes(r.x), bytes(r.y), bytes(r.w), bytes(r.fold)))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        coef, intercept = fit_folds(blocks, w, b, folds, est.getRegParam(), est.getMaxIter(), est.getTol())
    finally:
        blocks.unpersist()
    return as_model(d, est, coef[-1], intercept[-1]), fold_margins(table, w, b, coef, intercept, label)


def as_model(d: DataFrame, est: LinearSVC, coef: np.ndarray, intercept: float) -> LinearSVCModel:
    """The coefficients as a fitted model, by the files that Spark ML saves one in."""
    spark, path = d.sparkSession, scratch_path(d.sparkSession, "svm")
    meta = dict({"class": "org.apache.spark.ml.classification.LinearSVCModel", "timestamp": 0, "sparkVersion": spark.version, "uid": est.uid},
                paramMap={q.name: est.getOrDefault(q) for q in est.params if est.isSet(q)}, defaultParamMap={q.name: est.getOrDefault(q) for q in est.params if est.hasDefault(q)})
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(coef.tolist(), float(intercept))], "c array<double>, intercept double").select(array_to_vector("c").alias("coefficients"), "intercept") \
        .coalesce(1).write.parquet(f"{path}/data")
    return LinearSVCModel.load(path)
