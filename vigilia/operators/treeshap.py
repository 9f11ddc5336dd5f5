"""Exact path-dependent TreeSHAP for Spark tree ensembles (Lundberg et al., 2018).

The ensemble is read from the saved model's node table (``<path>/data``: one row per node with split feature, threshold,
children and statistics), so its size is the model's, not the data's; it is broadcast once. Attribution runs in
``mapInPandas`` over ``ROWS`` rows at a time. A leaf's game is a product over the features of its path (the row meets the
feature's conditions, or the share of the cover that does), so its Shapley value is an integral of a polynomial in one
variable, which Gauss-Legendre nodes give exactly. It depends only on which conditions a row meets.

Each tree is cut into units: a subtree at the end of a path, small enough that the bits of the path's features and of the
subtree's splits number ``BITS`` at most. A table over all patterns of these bits holds the Shapley values of all leaves of
the unit together, made once per ``ROWS`` rows by doubling; a row packs its pattern on the way down the tree and looks the
unit's features up. Longer paths are worked out for the patterns that rows really have. Rows stand as the ranks of their
values among the ensemble's thresholds, and patterns in 16 bits where a tree's fit, so that most steps touch a byte or two.

A random forest's output is the mean over trees of the class-1 leaf share; a boosted ensemble's is the sum of tree weight x
leaf value, the margin. ``base + sum(shap)`` is the probability (forest) or the margin (boosted) of every row.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ROWS = 1 << 17  # rows explained together: a unit's table is made once for them
BITS = 11  # of a unit's pattern table


def tree_arrays(model, spark) -> list[dict]:
    """Node arrays per tree from the saved model: left, right, feature, threshold, value, cover.

    A value is the tree's share of the ensemble's output: class-1 share over the number of trees (forest), or the leaf's
    prediction times the tree's weight (boosted trees)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/treeshap-{model.uid}"
    model.write().overwrite().save(path)
    boosted = is_boosted(model)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        "nodeData.split.leftCategoriesOrThreshold", "nodeData.impurityStats").toPandas()  # model-sized
    scale = list(model.treeWeights) if boosted else [1.0 / model.getNumTrees] * model.getNumTrees
    trees = []
    for tree, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        left, right, feat = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        thr, value, cover = np.zeros(n), np.zeros(n), np.zeros(n)
        for r in g.itertuples(index=False):
            i = int(r.id)
            left[i], right[i] = int(r.leftChild), int(r.rightChild)
            feat[i] = int(r.featureIndex) if r.featureIndex is not None else 0
            t = r.leftCategoriesOrThreshold
            thr[i] = float(t[0]) if t is not None and len(t) else 0.0
            stats = np.asarray(r.impurityStats, dtype=float)
            if boosted:  # weight, sum, sum of squares
                cover[i], value[i] = stats[0], float(r.prediction) * scale[int(tree)]
            else:  # weight per class
                cover[i] = stats.sum()
                value[i] = stats[1] / cover[i] * scale[int(tree)] if cover[i] > 0 and len(stats) > 1 else 0.0
        trees.append(dict(left=left, right=right, feat=feat, thr=thr, value=value, cover=cover))
    return trees


def is_boosted(model) -> bool:
    return type(model).__name__.startswith("GBT")


@functools.cache
def _gauss(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on (0, 1), exact up to the degree d - 1."""
    nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    return (nodes + 1) / 2, weights / 2


def _doubled(share: np.ndarray, value: float) -> np.ndarray:
    """Shapley values (features x 2^d patterns) of a leaf: bit k of a pattern says that feature k's conditions hold."""
    at, weights = _gauss(len(share))
    off = (1 - at) * share[:, None]  # factor of a feature whose conditions fail, features x nodes
    on = off + at
    product = value * weights[None, :]
    for k in range(len(share)):
        product = np.concatenate([product * off[k], product * on[k]])
    bits = (np.arange(1 << len(share)) >> np.arange(len(share))[:, None] & 1).astype(bool)
    return np.where(bits, (1 - share[:, None]) * ((1 / on) @ product.T), -share[:, None] * ((1 / off) @ product.T))


def _pattern_values(met: np.ndarray, share: np.ndarray, value: float) -> np.ndarray:
    """Shapley values (features x patterns) of a leaf; ``met``: features x patterns, whether the conditions hold."""
    total = np.zeros(met.shape)
    for at, w in zip(*_gauss(len(share))):
        factors = at * met + (1 - at) * share[:, None]
        total += w * factors.prod(axis=0, keepdims=True) / factors
    return value * (met - share[:, None]) * total


def units(t: dict, bits: int = BITS) -> dict:
    """The tree as nested dicts: an inner node above units has feature, threshold and children; a unit has the splits of its
    subtree (bits behind those of its path) and per leaf value, features, shares and the bits that each feature needs."""
    left, right, feat, thr, value, cover = (t[c].tolist() for c in ("left", "right", "feat", "thr", "value", "cover"))
    inner = [0] * len(left)  # splits in the subtree

    def children(j: int) -> list[int]:
        return [] if left[j] < 0 else [left[j], right[j]]

    order, stack = [], [0]
    while stack:
        order.append(j := stack.pop())
        stack += children(j)
    for j in reversed(order):
        inner[j] = 1 + sum(inner[c] for c in children(j)) if children(j) else 0

    def unit(j: int, path: dict) -> dict:
        """``path``: feature -> share, in the order of the path's bits."""
        splits, leaves, todo = [], [], [(j, {f: (s, 1 << k, 0) for k, (f, s) in enumerate(path.items())})]
        while todo:
            i, held = todo.pop()
            if not children(i):
                if held and value[i] != 0:
                    leaves.append((value[i], list(held), np.array([s for s, *_ in held.values()]), [(yes, no) for _, yes, no in held.values()]))
                continue
            bit = 1 << (len(path) + len(splits))
            splits.append((feat[i], thr[i]))
            for c, is_left in ((left[i], True), (right[i], False)):
                if cover[c] > 0:
                    share, yes, no = held.get(feat[i], (1.0, 0, 0))
                    todo.append((c, held | {feat[i]: (share * cover[c] / cover[i], yes | bit if is_left else yes, no if is_left else no | bit)}))
        return {"splits": splits, "leaves": leaves, "bits": len(path) + len(splits), "base": len(path)}

    def node(j: int, path: dict) -> dict:
        if len(path) + inner[j] <= bits or not children(j):
            return unit(j, path)
        f, out = feat[j], {"feature": feat[j], "threshold": thr[j], "bit": list(path).index(feat[j]) if feat[j] in path else len(path), "fresh": feat[j] not in path, "children": []}
        for c in children(j):
            out["children"].append(node(c, path | {f: path.get(f, 1.0) * cover[c] / cover[j]}) if cover[c] > 0 else None)
        return out

    return node(0, {})


def _explain_unit(columns: np.ndarray, u: dict, pattern: np.ndarray, total: np.ndarray) -> None:
    if not u["leaves"]:
        return
    for k, (f, thr) in enumerate(u["splits"]):
        pattern = pattern | (columns[f] <= thr).astype(pattern.dtype) << (u["base"] + k)
    if tabled := 1 << u["bits"] <= max(2, len(pattern)) and u["bits"] <= BITS:
        patterns, place = np.arange(1 << u["bits"], dtype=np.int16), pattern.astype(np.intp)
    else:
        patterns, place = np.unique(pattern, return_inverse=True)
    sums: dict = {}
    for value, features, share, needs in u["leaves"]:
        met = [patterns & (yes | no) == yes for yes, no in needs]
        if tabled and len(features) <= BITS:
            code = np.zeros(len(patterns), np.int16)
            for k, m in enumerate(met):
                code |= m.astype(np.int16) << k
            got = _doubled(share, value).take(code.astype(np.intp), axis=1)
        else:
            got = _pattern_values(np.array(met, dtype=float), share, value)
        for f, v in zip(features, got):
            sums[f] = sums[f] + v if f in sums else v
    for f, v in sums.items():
        total[f] += v.take(place)


def _width(at: dict | None) -> int:
    """Bits of the tree's widest pattern."""
    return 0 if at is None else at["bits"] if "splits" in at else max(at["bit"] + 1, *map(_width, at["children"]))


def _splits(at: dict | None):
    if at is not None and "splits" in at:
        yield from at["splits"]
    elif at is not None:
        yield at["feature"], at["threshold"]
        for child in at["children"]:
            yield from _splits(child)


def _ranked(at: dict | None, cuts: list[np.ndarray]) -> dict | None:
    """The tree with the ranks of its thresholds in ``cuts`` in their place."""
    rank = lambda f, thr: int(np.searchsorted(cuts[f], thr))
    if at is None:
        return None
    if "splits" in at:
        return at | {"splits": [(f, rank(f, thr)) for f, thr in at["splits"]]}
    return at | {"threshold": rank(at["feature"], at["threshold"]), "children": [_ranked(c, cuts) for c in at["children"]]}


def ranked(tops: list[dict], n_features: int) -> tuple[list[dict], list[np.ndarray]]:
    """The trees with ranks for thresholds, and the ensemble's sorted thresholds of each feature."""
    cuts: list[set] = [set() for _ in range(n_features)]
    for top in tops:
        for f, thr in _splits(top):
            cuts[f].add(thr)
    held = [np.array(sorted(c), dtype=float) for c in cuts]
    return [_ranked(top, held) for top in tops], held


def _explain_tree(columns: np.ndarray, top: dict, total: np.ndarray) -> None:
    """Adds one tree's SHAP values to ``total``; ``columns`` (ranks, as the tree's thresholds) and ``total``: features x rows."""
    stack = [(top, np.zeros(len(total[0]), np.int16 if _width(top) < 16 else np.int64))]
    while stack:
        at, pattern = stack.pop()
        if at is None:
            continue
        if "splits" in at:
            _explain_unit(columns, at, pattern, total)
            continue
        went_left, bit = columns[at["feature"]] <= at["threshold"], at["bit"]
        fresh = at["fresh"]
        for child, met in zip(at["children"], (went_left, ~went_left)):
            met = met.astype(pattern.dtype) << bit
            stack.append((child, pattern | met if fresh else pattern & (met | pattern.dtype.type(~(1 << bit)))))


def tree_shap(X: np.ndarray, tops: list[dict]) -> np.ndarray:
    """SHAP values (rows x features) of the ensemble whose trees are ``units``."""
    return ranked_shap(X, *ranked(tops, X.shape[1]))


def ranked_shap(X: np.ndarray, tops: list[dict], cuts: list[np.ndarray]) -> np.ndarray:
    """SHAP values of the ensemble as ``ranked`` gives it."""
    # a missing value goes right at every split, as in the model
    columns = np.nan_to_num(X, nan=np.inf, posinf=np.inf, neginf=-np.finfo(float).max).T
    # x <= threshold number k where at most k thresholds are below x
    columns = [np.searchsorted(c, x).astype(np.uint8 if len(c) < 256 else np.int64) for c, x in zip(cuts, columns)]
    total = np.zeros((X.shape[1], len(X)))
    for top in tops:
        _explain_tree(columns, top, total)
    return total.T


def expected_value(trees: list[dict]) -> float:
    """Base value of the ensemble: sum over trees of the cover-weighted mean leaf value."""
    vals = []
    for t in trees:
        leaves = t["left"] < 0
        vals.append(float((t["value"][leaves] * t["cover"][leaves]).sum() / t["cover"][0]))
    return float(np.sum(vals))


def shap_rows(model, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("obs_id",)) -> DataFrame:
    """M5: one row per observation: (keep..., factors, base, p), where ``factors`` is an array of
    (neg_abs, ord, feature, value, impact) in feature order; boosted trees add ``margin``, to which base and impacts sum.

    ``model`` is a fitted pipeline ending in a random forest or boosted trees; ``df`` the rows to explain. Python returns two
    arrays per row; names and structs are put together JVM-side, without a shuffle.
    """
    spark = df.sparkSession
    trees = tree_arrays(model.stages[-1], spark)
    bc = spark.sparkContext.broadcast(ranked([units(t) for t in trees], len(features)))  # model-sized
    from .models import feature_frame
    out = ["p", *(["margin"] if is_boosted(model.stages[-1]) else [])]
    x = model.transform(feature_frame(df, features)).select(
        *keep, vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p"),
        *[vector_to_array("rawPrediction")[1].alias(c) for c in out[1:]])
    schema = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in keep) + ", x array<double>, phi array<double>, " + ", ".join(f"{c} double" for c in out)

    def run(batches):
        tops, cuts = bc.value
        for pdf in _together(batches, ROWS):
            res = pdf[[*keep, "x", *out]].copy()
            res["phi"] = list(ranked_shap(np.vstack(pdf["x"].to_numpy()).astype(float), tops, cuts))
            yield res[[*keep, "x", "phi", *out]]

    names = F.array(*[F.lit(f) for f in features])
    factor = lambda i: F.struct((-F.abs(F.get("phi", i))).alias("neg_abs"), i.alias("ord"), F.get(names, i).alias("feature"),
                                F.get("x", i).alias("value"), F.get("phi", i).alias("impact"))
    return x.mapInPandas(run, schema).select(
        *keep, F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), factor).alias("factors"),
        F.lit(expected_value(trees)).alias("base"), *out)


def _together(batches, rows: int):
    """Arrow batches joined to about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        if len(b):
            held.append(b)
            n += len(b)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def shap_long(model, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("obs_id",)) -> DataFrame:
    """M5 long form: (keep..., feature, ord, value, shap, base, p), and margin for boosted trees."""
    rows = shap_rows(model, df, features, keep)
    out = [c for c in rows.columns if c not in (*keep, "factors")]
    rows = rows.select(*keep, F.explode("factors").alias("f"), *out)
    return rows.select(*keep, "f.feature", "f.ord", "f.value", F.col("f.impact").alias("shap"), *out)
