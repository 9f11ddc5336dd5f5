"""Histogram trees for many rows against Spark ML's and a brute-force search."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigilia.operators import models as MD
from vigilia.operators import trees as TR

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, k, 1500) / 2 for k in (4, 9, 20, 30)], axis=1)
    y = (x[:, 0] + x[:, 1] * rng.normal(1, 1, 1500) + x[:, 3] / 10 > 4).astype(float)
    d = spark.createDataFrame([(*map(float, r), float(v), 2.0 if v else 0.5) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in [*FEATURES, "y", "w"])).repartition(3)
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(d).persist()


def _p(model, rows):
    got = model.transform(rows).select(vector_to_array("features").alias("x"), "y", vector_to_array("probability")[1].alias("p")).toPandas()
    return got.sort_values(["p"]).p.to_numpy(), got


@pytest.mark.parametrize("leaf", [1, 40])
def test_boosted_trees_are_spark_mls_where_nothing_is_drawn(spark, rows, monkeypatch, leaf):
    est = GBTClassifier(labelCol="y", weightCol="w", maxIter=5, maxDepth=4, stepSize=0.3, minInstancesPerNode=leaf, seed=1)
    want = est.fit(rows)
    monkeypatch.setattr(TR, "BOOST_ROWS", 1)
    monkeypatch.setattr(TR, "BLOCK", 100)
    monkeypatch.setattr(TR, "KEPT_FITS", 2)
    got = TR.Trees(est).fit(rows)
    assert got.treeWeights == want.treeWeights and got.numFeatures == 4
    a, b = ({tuple(r.x): r.p for r in m.transform(rows).select(vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p")).distinct().collect()} for m in (got, want))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9
    assert np.abs(got.featureImportances.toArray() - want.featureImportances.toArray()).max() < 1e-9


def test_forest_is_the_same_from_a_task_and_from_levels(spark, rows, monkeypatch):
    est = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=5, maxDepth=6, minInstancesPerNode=3, seed=7)
    monkeypatch.setattr(TR, "FOREST_ROWS", 1)
    monkeypatch.setattr(TR, "BLOCK", 200)
    monkeypatch.setattr(TR, "NODES", 4)
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("Spark ML's forest"))
    one = TR.Trees(est).fit(rows)
    monkeypatch.setattr(TR, "TOGETHER", 0)
    monkeypatch.setattr(TR, "HELD", 4096)
    two = TR.Trees(est).fit(rows)
    assert one.toDebugString == two.toDebugString and one.getNumTrees == 5
    p, got = _p(one, rows)
    assert ((got.p > 0.5) == (got.y > 0.5)).mean() > 0.6 and 0 <= p.min() < p.max() <= 1


def test_forest_scores_like_spark_mls(spark, rows, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    est = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=30, maxDepth=5, minInstancesPerNode=2, seed=7)
    learn, held = rows.filter("pmod(hash(a, b, c, d), 3) > 0"), rows.filter("pmod(hash(a, b, c, d), 3) = 0")
    auc = BinaryClassificationEvaluator(labelCol="y").evaluate
    want = auc(est.fit(learn).transform(held))
    monkeypatch.setattr(TR, "FOREST_ROWS", 1)
    assert abs(auc(TR.Trees(est).fit(learn).transform(held)) - want) < 0.02


def test_best_split_by_brute_force():
    rng = np.random.default_rng(2)
    n, p = 300, dict(bins=6, leaf=20, features=5, weights=np.array([0.7, 1.9]), cuts=np.array([5, 5, 3, 5, 0]))
    bins, y, times, place = (rng.integers(0, k, n) for k in (2, 2, 4, 3))
    bins = np.stack([rng.integers(0, c + 1, n) for c in p["cuts"]], axis=1)
    of = np.array([[0, 2, 3], [1, 2, 4], [0, 1, 3]])
    h = TR.counted((2 * bins + y[:, None]).astype(np.uint8).reshape(-1), np.arange(n) * 5, place, times.astype(float), of, p)
    feat, cut, gain, left = TR.best_splits(h, of, p)
    gini = lambda rows: 1 - sum((w / max(sum(s), 1e-300)) ** 2 for s in [[p["weights"][c] * times[rows & (y == c)].sum() for c in (0, 1)]] for w in s)
    size = lambda rows: sum(p["weights"][c] * times[rows & (y == c)].sum() for c in (0, 1))
    for k in range(3):
        here, best = place == k, (-1,)
        for f in of[k]:
            for c in range(p["cuts"][f]):
                low, high = here & (bins[:, f] <= c), here & (bins[:, f] > c)
                if min(times[low].sum(), times[high].sum()) >= p["leaf"]:
                    best = max(best, (gini(here) - size(low) / size(here) * gini(low) - size(high) / size(here) * gini(high), f, c, times[low & (y == 0)].sum(), times[low & (y == 1)].sum()))
        assert abs(gain[k] - best[0]) < 1e-9 and (feat[k], cut[k], *left[k]) == best[1:]


def test_cut_points_and_bags():
    assert TR.cut_points(np.array([1.0, 3, 3, np.nan, 2]), np.ones(5), 32).tolist() == [1.5, 2.5]
    cuts = TR.cut_points(np.arange(1000.0), np.ones(1000), 8)
    assert len(cuts) == 7 and np.abs(cuts - np.arange(1, 8) * 125).max() < 2
    taken = np.concatenate([TR.bag(3, 0, 0, k, 1000) for k in range(100)])
    assert abs(taken.mean() - 1) < 0.01 and abs((taken == 0).mean() - np.exp(-1)) < 0.01 and abs(taken.var() - 1) < 0.02


def test_other_labels_and_small_tables_stay_with_spark_ml(spark, rows, monkeypatch):
    calls = []
    real = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, d: calls.append(1) or real(self, d))
    est = RandomForestClassifier(labelCol="y", numTrees=2, maxDepth=2, seed=1)
    TR.Trees(est).fit(rows)
    monkeypatch.setattr(TR, "FOREST_ROWS", 1)
    assert TR.Trees(est).fit(rows.withColumn("y", F.when(F.col("a") > 1, 2.0).otherwise(F.col("y")))).numClasses == 3 and len(calls) == 2


def test_grid_search_of_many_rows_grows_its_own_trees(spark, monkeypatch):
    from paths import SF_SMALL
    from vigilia.functions import constants as K
    from vigilia.operators import labels as L
    from vigilia.plans import prepare as PR
    from vigilia.sources import tables as T
    data = L.label_sirs_organ(PR.prepared_table(T.vitals(spark, SF_SMALL), drop_leakage=False))
    monkeypatch.setattr(TR, "FOREST_ROWS", 1)
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("a job for each group of nodes"))
    got = MD.grouped_grid_search(data, [dict(numTrees=6, maxDepth=4, minInstancesPerNode=2, featureSubsetStrategy="sqrt")], K.F17, "sepsis_label", "patient_id", folds=2)
    assert got.first().cv_auc > 0.7
