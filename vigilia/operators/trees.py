"""Forests and boosted trees for many rows (J1, J2, Z7): histogram trees with the rules of Spark ML's trainers.

Spark ML gathers the statistics of every open node from every partition, node by node, in JVM objects; a deep forest takes a job
and a shuffle of some hundred MB per group of nodes. Here rows are kept as blocks of bin numbers (a byte a feature), a block's
histograms are a few numpy calls, and the model is written in Spark ML's format and loaded as its class.

What stays: at most ``maxBins`` bins per feature from sampled quantiles, Poisson bags (forest) or shares without replacement
(boosted trees), features drawn per node, weighted Gini or variance gain, leaf sizes in rows, leaf pairs of one class merged,
boosting on the log loss's gradient. The draws are this module's own: seeded by tree and block, whatever task holds the block.

* Forest, bins of at most ``TOGETHER`` bytes in all: counted first, then broadcast; a task grows a tree at a time.
* Forest of more rows: level by level; tasks count their blocks, counts are summed per tree by a shuffle, splits are collected.
* Boosted trees: a job per level over kept blocks with their margins; of two children only the smaller is counted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

FOREST_ROWS = 1 << 15  # fewer rows are Spark ML's: its forest is faster there
BOOST_ROWS = 1 << 20  # the same for boosted trees, whose levels are a job each
TOGETHER = 192 << 20  # bytes of bins that are broadcast
BLOCK = 1 << 15  # rows counted together
SAMPLE = 1 << 16  # rows behind the cut points (Spark ML takes 10,000)
HELD = 64 << 20  # bytes of histograms that a task holds
NODES = 256  # of one tree counted together in a task that grows it
KEPT_FITS = 20  # boosting rounds between checkpoints of the margins
HANDLED = {"featuresCol", "labelCol", "weightCol", "predictionCol", "probabilityCol", "rawPredictionCol", "seed", "numTrees", "maxIter", "maxDepth",
           "minInstancesPerNode", "featureSubsetStrategy", "stepSize", "maxBins"}  # other parameters are Spark ML's
NODE = ("treeID int, nodeData struct<id:int, prediction:double, impurity:double, impurityStats:array<double>, rawCount:bigint, gain:double, "
        "leftChild:int, rightChild:int, split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>")
_BAGS = np.repeat(np.arange(9, dtype=np.uint8), np.diff(np.round(np.concatenate(
    [[0], np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]), [1]]) * 65536).astype(int)))  # Poisson(1) by 16 bits


class Trees(Estimator):
    """``estimator`` (a forest's or boosted trees' of two classes) for tables of any size: Spark ML's below the row limits."""

    def __init__(self, estimator):
        super().__init__()
        self.estimator = estimator

    def _fit(self, dataset: DataFrame):
        est, n = self.estimator, dataset.count()
        boosted = isinstance(est, GBTClassifier)
        asked = {q.name for q in est.params if est.isSet(q)}
        if n < (BOOST_ROWS if boosted else FOREST_ROWS) or not asked <= (HANDLED | ({"subsamplingRate"} if boosted else set())) or est.getMaxBins() > 127:
            return est.fit(dataset)
        weights = class_weights(dataset, est.getLabelCol(), est.getWeightCol() if est.isSet("weightCol") else None)
        if weights is None:  # other labels, or weights within a class
            return est.fit(dataset)
        return (fit_boosted if boosted else fit_forest)(dataset, est, n, weights)


# ---------------------------------------------------------------- bins
def cut_points(values: np.ndarray, weights: np.ndarray, max_bins: int) -> np.ndarray:
    """At most ``max_bins`` - 1 thresholds: between all values if they are few, else at equal steps of the weight."""
    known = ~np.isnan(values)
    found, at = np.unique(values[known], return_inverse=True)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) < max_bins:
        return middle
    below = np.cumsum(np.bincount(at, weights=weights[known]))
    step, cuts, target = below[-1] / max_bins, [], below[-1] / max_bins
    for k in range(1, len(found)):
        if abs(below[k - 1] - target) < abs(below[k] - target):
            cuts.append(middle[k - 1])
            target += step
    return np.array(cuts[:max_bins - 1])


def sampled_cuts(d: DataFrame, vec: str, weight: str | None, n: int, max_bins: int, seed: int) -> list[np.ndarray]:
    got = d.select(vector_to_array(vec).alias("x"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    got = got.sample(min(1.0, SAMPLE / n), seed).toPandas()
    return [cut_points(c, got["w"].to_numpy(float), max_bins) for c in np.vstack(got["x"].to_numpy()).T]


def blocks_of(d: DataFrame, vec: str, label: str, cuts: list[np.ndarray], by_column: bool):
    """RDD of (partition, number, rows, bins, labels): bytes, bins row by row or column by column. A missing value is in the last bin."""
    def run(batches):
        held, n, part, k = [], 0, -1, 0
        for last, batch in _with_last(batches):
            if batch is not None and batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                held.append((np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1).astype(np.uint8), batch.column(1).to_numpy(zero_copy_only=False)))
                n, part = n + batch.num_rows, batch.column(2)[0].as_py()
            if n and (last or n >= BLOCK):
                bins, y = (np.concatenate(c) for c in zip(*held))
                yield pa.RecordBatch.from_pylist([dict(part=part, k=k, n=n, bins=(bins.T if by_column else bins).tobytes(), y=y.astype(np.uint8).tobytes())], schema=out)
                held, n, k = [], 0, k + 1

    out = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary())])
    rows = d.select(vector_to_array(vec).alias("x"), F.col(label).cast("double").alias("y"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, "part int, k int, n int, bins binary, y binary").rdd.map(
        lambda r: (r.part, r.k, r.n, bytes(r.bins), bytes(r.y)))


def spread(blocks):
    """Blocks, which begin with their partition and number, dealt evenly to one partition a core; their draws go by these numbers."""
    return blocks.map(lambda b: (b[0] + b[1], b)).partitionBy(blocks.context.defaultParallelism, int).values()


def _with_last(batches):
    """(False, batch) for each, then (True, None)."""
    for b in batches:
        yield False, b
    yield True, None


def class_weights(d: DataFrame, label: str, weight: str | None) -> np.ndarray | None:
    """Weight of the rows of class 0 and 1; None where there are other classes or weights differ within one."""
    found = {r[0]: r for r in d.groupBy(label).agg(*[f(F.col(weight) if weight else F.lit(1.0)) for f in (F.min, F.max)]).collect()}
    if not set(found) <= {0.0, 1.0} or any(r[1] != r[2] for r in found.values()):
        return None
    return np.array([found[c][1] if c in found else 1.0 for c in (0.0, 1.0)])


def drawn(strategy: str, n: int) -> int:
    """Number of features of a node, as Spark ML reads ``featureSubsetStrategy`` for a forest of several trees."""
    named = {"auto": math.ceil(math.sqrt(n)), "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "all": n, "onethird": math.ceil(n / 3)}
    if strategy in named:
        return named[strategy]
    return min(n, int(strategy)) if "." not in strategy else math.ceil(float(strategy) * n)


# ---------------------------------------------------------------- forest
def bag(seed: int, tree: int, part: int, k: int, n: int) -> np.ndarray:
    """How often the tree takes each row of a block."""
    return _BAGS.take(np.random.default_rng([seed, tree, part, k]).integers(0, 65536, n, np.uint16))


class Tree:
    """A tree while it grows: nodes in order of depth, ``open`` those that may split, with the features drawn for them."""

    def __init__(self, seed: int, tree: int, root: np.ndarray, p: dict):
        self.seed, self.tree, self.p, self.depth = seed, tree, p, 0
        self.counts, self.feat, self.cut, self.left, self.gain = root[None, :], *(np.full(1, v) for v in (-1, 0, -1)), np.full(1, -1.0)
        self._open(np.zeros(1, np.int64))

    def _open(self, nodes: np.ndarray) -> None:
        if self.depth == self.p["depth"]:
            nodes = nodes[:0]
        counts = self.counts[nodes]
        self.open = nodes[(counts > 0).all(axis=1) & (counts.sum(axis=1) >= 2 * self.p["leaf"])]
        ranks = np.random.default_rng([self.seed, self.tree, self.depth, 1]).random((len(self.open), self.p["features"]), np.float32)
        self.drawn = np.argpartition(ranks, self.p["drawn"] - 1, axis=1)[:, :self.p["drawn"]]
        self.drawn = np.sort(self.drawn, axis=1)

    def extend(self, feat: np.ndarray, cut: np.ndarray, gain: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Splits the open nodes with a gain; ``left``: their counts of rows by class. Returns which were split."""
        split = gain > 1e-14
        at, n = self.open[split], len(self.left)
        self.feat[at], self.cut[at], self.gain[at], self.left[at] = feat[split], cut[split], gain[split], n + 2 * np.arange(len(at))
        new = np.stack([left[split], self.counts[at] - left[split]], axis=1).reshape(-1, 2)
        self.counts = np.concatenate([self.counts, new])
        for name, v in (("feat", -1), ("cut", 0), ("left", -1), ("gain", -1.0)):
            setattr(self, name, np.concatenate([getattr(self, name), np.full(len(new), v)]))
        self.depth += 1
        self._open(np.arange(n, n + len(new)))
        return split

    def walk(self) -> tuple:
        """(feature, bin code, left child, place among the open nodes or -1) of each node; a leaf leads to itself."""
        inner = self.left >= 0
        place = np.full(len(inner), -1, np.int32)
        place[self.open] = np.arange(len(self.open))
        return (np.where(inner, self.feat, 0).astype(np.int32), np.where(inner, 2 * self.cut + 1, 255).astype(np.uint8),
                np.where(inner, self.left, np.arange(len(inner))).astype(np.int32), place)

    def nodes(self, weights: np.ndarray, cuts: list[np.ndarray]) -> pd.DataFrame:
        """The nodes as Spark ML saves them, leaf pairs that predict one class merged."""
        stats = self.counts * weights
        says, left = (stats[:, 1] > stats[:, 0]).astype(float), self.left.copy()
        for i in np.flatnonzero(left >= 0)[::-1]:  # children have larger numbers
            c = left[i]
            if left[c] < 0 and left[c + 1] < 0 and says[c] == says[c + 1]:
                left[i] = -1
        kept = np.zeros(len(left), bool)
        kept[0] = True
        for i in np.flatnonzero(left >= 0):
            if kept[i]:
                kept[left[i]] = kept[left[i] + 1] = True
        total = stats.sum(axis=1)
        impurity = 1 - ((stats / np.where(total > 0, total, 1)[:, None]) ** 2).sum(axis=1)
        return node_rows(self.tree, kept, left, self.feat, self.cut, self.gain, says, impurity, stats, self.counts.sum(axis=1), cuts)


def node_rows(tree: int, kept: np.ndarray, left: np.ndarray, feat: np.ndarray, cut: np.ndarray, gain: np.ndarray, says: np.ndarray,
              impurity: np.ndarray, stats: np.ndarray, counts: np.ndarray, cuts: list[np.ndarray]) -> pd.DataFrame:
    number = np.cumsum(kept) - 1
    rows = []
    for i in np.flatnonzero(kept).tolist():
        inner = left[i] >= 0
        rows.append(dict(id=int(number[i]), prediction=float(says[i]), impurity=float(impurity[i]), impurityStats=stats[i].tolist(), rawCount=int(counts[i]),
                         gain=float(gain[i]) if inner else -1.0, leftChild=int(number[left[i]]) if inner else -1, rightChild=int(number[left[i] + 1]) if inner else -1,
                         split=dict(featureIndex=int(feat[i]) if inner else -1, leftCategoriesOrThreshold=[float(cuts[feat[i]][cut[i]])] if inner else [], numCategories=-1)))
    return pd.DataFrame({"treeID": np.full(len(rows), tree, np.int32), "nodeData": rows})


def counted(bins: np.ndarray, at: np.ndarray, place: np.ndarray, times: np.ndarray, of: np.ndarray, p: dict) -> np.ndarray:
    """Rows (nodes x features drawn x bins x class). ``bins``: bin codes (2 x bin + class) of all rows, ``at``: where a row's begin,
    ``place``: its node among ``of``, the features drawn."""
    f = of.take(place, axis=0)
    f += at[:, None]
    wide = 2 * p["bins"]
    key = (np.arange(of.size, dtype=np.int64) * wide).reshape(of.shape).take(place, axis=0)
    key += bins.take(f)
    return np.bincount(key.reshape(-1), weights=np.repeat(times, of.shape[1]), minlength=of.size * wide).reshape(*of.shape, p["bins"], 2)


def best_splits(h: np.ndarray, of: np.ndarray, p: dict) -> tuple:
    """(feature, cut, gain, counts left) of the best split of each node by weighted Gini; a gain of -1 for none."""
    total = h[:, 0].sum(axis=1)
    low = h.cumsum(axis=2)[:, :, :-1]
    rows = low.sum(axis=-1)
    fits = (rows >= p["leaf"]) & (total.sum(axis=1)[:, None, None] - rows >= p["leaf"]) & (np.arange(p["bins"] - 1) < p["cuts"][of][:, :, None])
    a, b = low[..., 0] * p["weights"][0], low[..., 1] * p["weights"][1]
    all_a, all_b = (total[:, c] * p["weights"][c] for c in (0, 1))
    whole = all_a + all_b
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (a * a + b * b) / (a + b)
        a, b = all_a[:, None, None] - a, all_b[:, None, None] - b
        score += (a * a + b * b) / (a + b)
    score = np.where(fits, score, -np.inf).reshape(len(h), -1)
    best = score.argmax(axis=1)
    node, k, cut = np.arange(len(h)), best // (p["bins"] - 1), best % (p["bins"] - 1)
    top = score[node, best]
    gain = np.where(np.isfinite(top), top / whole - (all_a ** 2 + all_b ** 2) / whole ** 2, -1.0)
    return of[node, k], cut, gain, low[node, k, cut]


def grow(tree: int, bins: np.ndarray, sizes: Sequence[tuple], seed: int, p: dict) -> Tree:
    """One tree from the bins of all rows; rows stand sorted by their node."""
    times = np.concatenate([bag(seed, tree, part, k, n) for part, k, n in sizes])
    rows = np.flatnonzero(times)
    times = times[rows].astype(float)
    at = rows * p["features"]  # where a row's bins begin
    y = bins.take(at) & 1
    t = Tree(seed, tree, np.array([times[y == 0].sum(), times[y == 1].sum()]), p)
    place = np.zeros(len(at) if len(t.open) else 0, np.int32)
    at, times = at[:len(place)], times[:len(place)]
    while len(t.open):
        found, ends = [], np.searchsorted(place, np.arange(0, len(t.open) + NODES, NODES))
        for lo in range(0, len(t.open), NODES):
            s, of = slice(ends[lo // NODES], ends[lo // NODES + 1]), t.drawn[lo:lo + NODES]
            h = sum(counted(bins, at[r], place[r] - lo, times[r], of, p) for r in (slice(i, min(i + BLOCK, s.stop)) for i in range(s.start, s.stop, BLOCK)))
            found.append(best_splits(h, of, p))
        feat, cut, gain, left = (np.concatenate(c) for c in zip(*found))
        before, opened = len(t.left), t.open
        t.extend(feat, cut, gain, left)
        child = t.left[opened][place]
        child += bins.take(at + t.feat[opened].astype(np.int64).take(place)) > 2 * t.cut[opened].take(place) + 1
        new = np.full(len(t.left) - before, -1, np.int32)
        new[t.open - before] = np.arange(len(t.open))
        place = np.where(t.left[opened][place] >= 0, new.take(np.maximum(child - before, 0)) if len(new) else -1, -1)
        order = np.flatnonzero(place >= 0)
        key = place[order]
        order = order[np.argsort(key.astype(np.uint16) if len(t.open) <= 65536 else key, kind="stable")]
        place, at, times = place[order].astype(np.int32), at[order], times[order]
    return t


def fit_forest(d: DataFrame, est: RandomForestClassifier, n: int, weights: np.ndarray) -> RandomForestClassificationModel:
    sc, spark = d.sparkSession.sparkContext, d.sparkSession
    vec, label, weight, seed = est.getFeaturesCol(), est.getLabelCol(), est.getWeightCol() if est.isSet("weightCol") else None, est.getSeed()
    cuts = sampled_cuts(d, vec, weight, n, est.getMaxBins(), seed)
    p = dict(depth=est.getMaxDepth(), leaf=est.getMinInstancesPerNode(), features=len(cuts), drawn=drawn(est.getFeatureSubsetStrategy(), len(cuts)),
             bins=max(2, 1 + max(map(len, cuts))), cuts=np.array(list(map(len, cuts))), weights=weights)
    blocks = blocks_of(d, vec, label, cuts, by_column=False).map(_coded)
    if n * len(cuts) <= TOGETHER:
        got = blocks.collect()
        held = sc.broadcast((b"".join(b for *_, b in got), [b[:3] for b in got]))
        del got

        def run(batches):
            raw, sizes = held.value
            for pdf in batches:
                for tree in pdf["id"]:
                    yield grow(int(tree), np.frombuffer(raw, np.uint8), sizes, seed, p).nodes(weights, cuts)

        trees = est.getNumTrees()
        nodes = spark.range(0, trees, 1, min(trees, 4 * sc.defaultParallelism)).mapInPandas(run, NODE)
        return as_model(d, est, nodes, [1.0] * trees, len(cuts))
    by_task = spread(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trees = grow_together(by_task, est.getNumTrees(), seed, p)
        nodes = spark.createDataFrame(pd.concat([t.nodes(weights, cuts) for t in trees], ignore_index=True), NODE)
        return as_model(d, est, nodes, [1.0] * len(trees), len(cuts))
    finally:
        by_task.unpersist()


def _coded(block: tuple) -> tuple:
    part, k, n, bins, y = block
    return part, k, n, (2 * np.frombuffer(bins, np.uint8).reshape(n, -1) + np.frombuffer(y, np.uint8)[:, None]).astype(np.uint8).tobytes()


def grow_together(blocks, n_trees: int, seed: int, p: dict) -> list[Tree]:
    """All trees level by level; a level's trees go in groups whose histograms fit ``HELD`` bytes of a task."""
    sc = blocks.context

    def roots(it):
        total = np.zeros((n_trees, 2))
        for part, k, n, raw in it:
            y = np.frombuffer(raw, np.uint8)[::p["features"]] & 1
            total += [np.bincount(y, weights=bag(seed, t, part, k, n), minlength=2) for t in range(n_trees)]
        yield total

    trees = [Tree(seed, t, r, p) for t, r in enumerate(blocks.mapPartitions(roots).sum())]
    while any(len(t.open) for t in trees):
        group, size = [], 0
        for t in [t for t in trees if len(t.open)]:
            group.append(t)
            size += t.drawn.size * p["bins"] * 2 * 4
            if size >= HELD:
                _split_level(sc, blocks, group, trees, seed, p)
                group, size = [], 0
        if group:
            _split_level(sc, blocks, group, trees, seed, p)
    return trees


def _split_level(sc, blocks, group: list[Tree], trees: list[Tree], seed: int, p: dict) -> None:
    held = sc.broadcast([(t.tree, t.depth, t.drawn, *t.walk()) for t in group])

    def count(it):
        sums = {}
        for part, k, n, raw in it:
            bins = np.frombuffer(raw, np.uint8)
            for tree, depth, of, feat, code, left, place in held.value:
                times = bag(seed, tree, part, k, n)
                rows = np.flatnonzero(times)
                at, node = rows * p["features"], np.zeros(len(rows), np.int32)
                for _ in range(depth):
                    node = left.take(node) + (bins.take(at + feat.take(node)) > code.take(node))
                where = place.take(node)
                if depth:
                    here = np.flatnonzero(where >= 0)
                    rows, at, where = rows[here], at[here], where[here]
                h = counted(bins, at, where, times[rows].astype(float), of, p)
                sums[tree] = sums[tree] + h.astype(np.int32) if tree in sums else h.astype(np.int32)
        for tree, h in sums.items():
            yield tree, h.astype(np.min_scalar_type(int(h.max())))

    def split(it):
        sums = {}
        for tree, h in it:
            sums[tree] = sums[tree] + h if tree in sums else h.astype(np.int64)
        of = {x[0]: x[2] for x in held.value}
        for tree, h in sums.items():
            yield tree, best_splits(h, of[tree], p)

    for tree, found in blocks.mapPartitions(count).partitionBy(min(len(group), sc.defaultParallelism)).mapPartitions(split).collect():
        trees[tree].extend(*found)
    held.unpersist()


# ---------------------------------------------------------------- boosted trees
def residual(y: np.ndarray, margin: np.ndarray, first: bool) -> np.ndarray:
    """What the next tree learns: the labels as -1 and 1, then the log loss's negative gradient."""
    sign = 2.0 * y - 1
    return sign if first else 4 * sign / (1 + np.exp(2 * sign * margin))


def fit_boosted(d: DataFrame, est: GBTClassifier, n: int, weights: np.ndarray) -> GBTClassificationModel:
    vec, label, weight, seed = est.getFeaturesCol(), est.getLabelCol(), est.getWeightCol() if est.isSet("weightCol") else None, est.getSeed()
    cuts = sampled_cuts(d, vec, weight, n, est.getMaxBins(), seed)
    p = dict(depth=est.getMaxDepth(), leaf=est.getMinInstancesPerNode(), features=len(cuts), drawn=drawn(est.getFeatureSubsetStrategy() if est.getFeatureSubsetStrategy() != "auto" else "all", len(cuts)),
             bins=max(2, 1 + max(map(len, cuts))), cuts=np.array(list(map(len, cuts))), weights=weights, share=est.getSubsamplingRate(), seed=seed)
    ensure_checkpoint_dir(d.sparkSession)
    state = spread(blocks_of(d, vec, label, cuts, by_column=True)).map(lambda b: (*b, np.zeros(b[2]).tobytes())).persist(StorageLevel.MEMORY_AND_DISK)
    before, frames, rates = None, [], [1.0] + [est.getStepSize()] * (est.getMaxIter() - 1)
    for m, rate in enumerate(rates):
        tree = boosted_tree(state, m, p)
        frames.append(node_rows(m, np.ones(len(tree["left"]), bool), tree["left"], tree["feat"], tree["cut"], tree["gain"], tree["says"], tree["impurity"], tree["stats"], tree["count"], cuts))
        if before is not None:
            before.unpersist()
        if m + 1 < len(rates):
            state, before = state.map(_advance(tree, rate)).persist(StorageLevel.MEMORY_AND_DISK), state
            if (m + 1) % KEPT_FITS == 0:
                state.checkpoint()
    state.unpersist()
    nodes = d.sparkSession.createDataFrame(pd.concat(frames, ignore_index=True), NODE)
    return as_model(d, est, nodes, rates, len(cuts))


def _steps(bins: np.ndarray, tree: dict) -> np.ndarray:
    """Node that each row has come to; ``bins``: features x rows."""
    n = bins.shape[1]
    inner = tree["left"] >= 0
    feat, cut = np.where(inner, tree["feat"], 0) * n, np.where(inner, tree["cut"], 255).astype(np.uint8)
    left = np.where(inner, tree["left"], np.arange(len(inner)))
    flat, rows, node = bins.reshape(-1), np.arange(n), np.zeros(n, np.int64)
    for _ in range(tree["depth"]):
        node = left.take(node) + (flat.take(feat.take(node) + rows) > cut.take(node))
    return node


def _advance(tree: dict, rate: float):
    def run(block):
        part, k, n, raw, y, margin = block
        said = tree["says"].take(_steps(np.frombuffer(raw, np.uint8).reshape(-1, n), tree))
        return part, k, n, raw, y, (np.frombuffer(margin) + rate * said).tobytes()
    return run


def _sums(state, m: int, tree: dict, counted_nodes: np.ndarray, p: dict) -> tuple:
    """Sums over the rows drawn: (weight, weight x residual, rows) by node, feature and bin, for ``counted_nodes``, the places of
    nodes or -1; and of (weight, weight x residual, its square, rows) by place, for all open nodes at the end of ``tree``."""
    n_places = int(counted_nodes.max()) + 1

    def run(it):
        wide = p["bins"]
        by_bin = np.zeros((2 + (p["leaf"] > 1), p["features"], n_places * wide))
        by_node = np.zeros((4, len(counted_nodes)))
        for part, k, n, raw, y, margin in it:
            bins, y = np.frombuffer(raw, np.uint8).reshape(-1, n), np.frombuffer(y, np.uint8)
            taken = np.random.default_rng([p["seed"], m, part, k]).random(n, np.float32) < p["share"] if p["share"] < 1 else np.ones(n, bool)
            node = _steps(bins, tree)
            w = np.where(taken, p["weights"].take(y), 0.0)
            r = w * residual(y, np.frombuffer(margin), m == 0)
            for i, v in enumerate((w, r, r * r / np.where(w > 0, w, 1), taken.astype(float))):
                by_node[i] += np.bincount(node, weights=v, minlength=len(counted_nodes))
            place = counted_nodes.take(node)
            here = np.flatnonzero((place >= 0) & taken)
            key, w, r = place[here] * wide, w[here], r[here]
            for f in range(p["features"]):
                at = key + bins[f].take(here)
                by_bin[0, f] += np.bincount(at, weights=w, minlength=n_places * wide)
                by_bin[1, f] += np.bincount(at, weights=r, minlength=n_places * wide)
                if p["leaf"] > 1:
                    by_bin[2, f] += np.bincount(at, minlength=n_places * wide)
        yield by_bin, by_node

    by_bin, by_node = map(sum, zip(*state.mapPartitions(run).collect()))
    return by_bin.reshape(len(by_bin), p["features"], n_places, p["bins"]).transpose(2, 1, 3, 0), by_node


def boosted_tree(state, m: int, p: dict) -> dict:
    """One regression tree on the residuals: variance gain, a leaf says their weighted mean."""
    t = dict(feat=np.full(1, -1), cut=np.zeros(1, int), left=np.full(1, -1), gain=np.full(1, -1.0), depth=0)
    counted_nodes, open_nodes = np.zeros(1, np.int64), np.zeros(1, np.int64)
    sums = np.zeros((4, 0))
    parents, tiny = None, 0.5 * p["weights"].min()
    while True:
        h, by_node = _sums(state, m, t, counted_nodes, p)
        sums = np.concatenate([sums, by_node[:, sums.shape[1]:]], axis=1)
        if parents is not None:  # counted: the smaller child of each pair; the other is what remains
            small, whole = h, parents
            h = np.empty((2 * len(small), *small.shape[1:]))
            pair = 2 * np.arange(len(small))
            first = counted_nodes[open_nodes[::2]] >= 0
            h[pair + ~first], h[pair + first] = small, whole - small
        rng = np.random.default_rng([p["seed"], m, t["depth"], 1])
        of = np.zeros((len(open_nodes), p["features"]), bool)
        np.put_along_axis(of, rng.random(of.shape).argsort(axis=1)[:, :p["drawn"]], True, axis=1)
        w, r = sums[0][open_nodes], sums[1][open_nodes]
        low = h.cumsum(axis=2)[:, :, :-1]
        lw, lr = low[..., 0], low[..., 1]
        rw = w[:, None, None] - lw
        fits = of[:, :, None] & (lw > tiny) & (rw > tiny) & (np.arange(p["bins"] - 1) < p["cuts"][None, :, None])
        if p["leaf"] > 1:
            rows = np.round(low[..., 2])
            fits &= (rows >= p["leaf"]) & (sums[3][open_nodes][:, None, None] - rows >= p["leaf"])
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(fits, lr ** 2 / lw + (r[:, None, None] - lr) ** 2 / rw, -np.inf).reshape(len(h), -1)
            best = score.argmax(axis=1)
            gain = np.where(w > 0, (score[np.arange(len(h)), best] - r ** 2 / w) / w, -np.inf)
        f, c = best // (p["bins"] - 1), best % (p["bins"] - 1)
        split = gain > 1e-14
        at, n = open_nodes[split], len(t["left"])
        t["feat"][at], t["cut"][at], t["gain"][at], t["left"][at] = f[split], c[split], gain[split], n + 2 * np.arange(len(at))
        for name, v in (("feat", -1), ("cut", 0), ("left", -1), ("gain", -1.0)):
            t[name] = np.concatenate([t[name], np.full(2 * len(at), v)])
        t["depth"] += 1
        left_w = lw[np.arange(len(h)), f, c][split]
        left_smaller = left_w <= w[split] / 2
        if not len(at) or t["depth"] == p["depth"]:
            break
        open_nodes, parents = np.arange(n, n + 2 * len(at)), h[split]
        counted_nodes = np.full(n + 2 * len(at), -1)
        counted_nodes[n + 2 * np.arange(len(at)) + ~left_smaller] = np.arange(len(at))
    if len(at):  # the last level's leaves
        sums = np.concatenate([sums, _leaf_sums(state, m, t, p)[:, sums.shape[1]:]], axis=1)
    w, r, square, rows = sums
    safe = np.where(w > 0, w, 1)
    return t | dict(says=r / safe, impurity=square / safe - (r / safe) ** 2, stats=np.stack([w, r, square], axis=1), count=np.round(rows).astype(int))


def _leaf_sums(state, m: int, tree: dict, p: dict) -> np.ndarray:
    return _sums(state, m, tree, np.full(len(tree["left"]), -1), p)[1]


# ---------------------------------------------------------------- the model
def as_model(d: DataFrame, est, nodes: DataFrame, tree_weights: Sequence[float], n_features: int):
    """The trees as a fitted model of ``est``, by the files that Spark ML saves a model in."""
    spark, boosted = d.sparkSession, isinstance(est, GBTClassifier)
    kind, tree = (GBTClassificationModel, "regression.DecisionTreeRegressionModel") if boosted else (RandomForestClassificationModel, "classification.DecisionTreeClassificationModel")
    path, n = scratch_path(spark, "trees"), len(tree_weights)

    def meta(name: str, uid: str, **more) -> str:
        return json.dumps(dict({"class": f"org.apache.spark.ml.{name}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid, "paramMap": {}, "defaultParamMap": {}}, **more))

    whole = meta(f"classification.{kind.__name__}", est.uid, numFeatures=n_features, numTrees=n, **({} if boosted else {"numClasses": 2}),
                 paramMap={q.name: est.getOrDefault(q) for q in est.params if est.isSet(q)}, defaultParamMap={q.name: est.getOrDefault(q) for q in est.params if est.hasDefault(q)})
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, meta(tree, f"{est.uid}_{i}"), float(w)) for i, w in enumerate(tree_weights)], "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    nodes.write.parquet(f"{path}/data")
    return kind.load(path)
