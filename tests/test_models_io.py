"""Models (TreeSHAP additivity, persistence) and file sources/sinks."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from vigilia.functions import constants as K
from vigilia.operators import labels as L
from vigilia.operators import models as MD
from vigilia.operators import profile as P
from vigilia.operators import quality as Q
from vigilia.operators import stays as STY
from vigilia.operators import treeshap as TS
from vigilia.plans import prepare as PR
from vigilia.sources import io as IO
from vigilia.sources import tables as T


@pytest.fixture(scope="module")
def data(spark):
    return L.label_sirs_organ(PR.prepared_table(T.vitals(spark, SF_SMALL), drop_leakage=False))


def test_tree_shap_sums_to_forest_probability(spark, data):
    m = MD.fit(data.filter("split_bucket < 70"), MD.ModelSpec("rf", "rf", dict(numTrees=8, maxDepth=4)), K.F39,
               "sepsis_label")
    sh = TS.shap_long(m, data.filter("split_bucket >= 85"), K.F39).toPandas()
    g = sh.groupby("obs_id").agg(s=("shap", "sum"), b=("base", "first"), p=("p", "first"))
    assert len(g) > 50 and (g.s + g.b - g.p).abs().max() < 1e-9


def test_tree_shap_matches_the_definition_over_all_subsets():
    import itertools
    import math

    import numpy as np
    # features 0 (twice on a path), 1 and 2; node: left, right, feature, threshold, value, cover
    nodes = [(1, 2, 0, 0.5, 0, 100), (3, 4, 1, 0.2, 0, 60), (5, 6, 0, 1.5, 0, 40), (-1, -1, 0, 0, 0.1, 25), (7, 8, 2, 0.0, 0, 35),
             (-1, -1, 0, 0, 0.7, 10), (-1, -1, 0, 0, 0.0, 30), (-1, -1, 0, 0, 0.9, 5), (-1, -1, 0, 0, 0.4, 30)]
    t = dict(zip(("left", "right", "feat", "thr", "value", "cover"), map(np.array, zip(*nodes))))

    def value(x, known, j=0):
        left, right, f, thr, v, cover = nodes[j]
        if left < 0:
            return v
        if f in known:
            return value(x, known, left if x[f] <= thr else right)
        return sum(nodes[c][5] / cover * value(x, known, c) for c in (left, right))

    X = np.random.default_rng(0).normal(0.5, 1, (40, 3))
    X[3, 1] = np.nan
    want = np.zeros_like(X)
    for r, x in enumerate(X):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            for k in range(3):
                for s in itertools.combinations(rest, k):
                    want[r, f] += math.factorial(k) * math.factorial(2 - k) / 6 * (value(x, {*s, f}) - value(x, {*s}))
    for rows in (X, X[:2]):  # tables, and the patterns that rows have
        for bits in (0, 1, 2, 3, 11):  # every leaf, part of the tree or the whole tree as a unit
            assert np.abs(TS.tree_shap(rows, [TS.units(t, bits)]) - want[:len(rows)]).max() < 1e-12


def test_tree_shap_of_boosted_trees_sums_to_the_margin(spark, data):
    m = MD.fit(data.filter("split_bucket < 70"), MD.ModelSpec("gbt", "gbt", dict(maxIter=6, maxDepth=4)), K.F39, "sepsis_label")
    sh = TS.shap_long(m, data.filter("split_bucket >= 85"), K.F39).toPandas()
    g = sh.groupby("obs_id").agg(s=("shap", "sum"), b=("base", "first"), m=("margin", "first"), p=("p", "first"))
    assert len(g) > 50 and (g.s + g.b - g.m).abs().max() < 1e-9
    assert (1 / (1 + (-2 * g.m).map(math.exp)) - g.p).abs().max() < 1e-9


def test_deep_trees_agree_with_tables():
    import numpy as np
    rng = np.random.default_rng(1)
    nodes = []  # a chain of 16 splits on 14 features: more bits than a table has

    def grow(depth, cover):
        i = len(nodes)
        nodes.append(None)
        if depth == 16 or cover < 2:
            nodes[i] = (-1, -1, 0, 0.0, rng.normal(), cover)
            return i
        low = grow(16 if depth % 2 else depth + 1, cover * 0.4)
        nodes[i] = (low, grow(depth + 1, cover * 0.6), depth % 14, rng.normal(), 0.0, cover)
        return i

    grow(0, 1e6)
    t = dict(zip(("left", "right", "feat", "thr", "value", "cover"), map(np.array, zip(*nodes))))
    X = rng.normal(0, 1, (300, 14))
    a, b = (TS.tree_shap(X, [TS.units(t, bits)]) for bits in (0, 11))
    assert np.abs(a - b).max() < 1e-9

    def out(x, j=0):
        return nodes[j][4] if nodes[j][0] < 0 else out(x, nodes[j][0] if x[nodes[j][2]] <= nodes[j][3] else nodes[j][1])

    assert np.abs(a.sum(axis=1) + TS.expected_value([t]) - [out(x) for x in X]).max() < 1e-9


def test_shap_queries_explain_the_forest_that_scores(spark):
    from vigilia.plans import catalog_models as CM
    model, _ = CM._explained(spark, SF_SMALL)
    assert model is CM.TR.fitted(spark, SF_SMALL, CM.RF, CM.LABEL) and model.stages[-1].getNumTrees == 200


def test_model_save_load_roundtrip(spark, data):
    m = MD.fit(data.filter("split_bucket < 70"), MD.ModelSpec("lr", "lr", dict(maxIter=20)), K.F17, "sepsis_label")
    path = tempfile.mkdtemp(prefix="vigilia-model-test-")
    MD.save(m, path, K.F17, 0.47)
    m2, meta = MD.load(path)
    assert meta["features"] == K.F17 and meta["threshold"] == 0.47
    a = MD.score(m, data, K.F17).orderBy("obs_id").toPandas()
    b = MD.score(m2, data, meta["features"]).orderBy("obs_id").toPandas()
    assert (a.p - b.p).abs().max() < 1e-12


def test_svm_save_load_roundtrip(spark, data):
    m = MD.fit(data.filter("split_bucket < 70"), MD.ModelSpec("svm", "rff_svm", dict(n_components=4, max_iter=3)), K.F17, "sepsis_label")
    path = tempfile.mkdtemp(prefix="vigilia-model-test-")
    MD.save(m, path, K.F17, 0.5)
    m2, meta = MD.load(path)
    a = MD.score(m, data, K.F17).orderBy("obs_id").toPandas()
    b = MD.score(m2, data, meta["features"]).orderBy("obs_id").toPandas()
    assert (a.p - b.p).abs().max() < 1e-12


def test_csv_line_numbers_follow_file_paths_and_nan_is_null(spark):
    path = tempfile.mkdtemp(prefix="vigilia-csv-")
    names = [c.split()[0] for c in IO.OBSERVATION_SCHEMA.split(", ")]
    for name, hours in (("a.csv", [0, 1]), ("b.csv", list(range(2, 400))), ("c.csv", [0])):  # the scan takes the largest first
        with open(f"{path}/{name}", "w") as f:
            f.write(",".join(names) + "\n")
            f.writelines(f"{h},NaN" + "," * (len(names) - 2) + "\n" for h in hours)
    raw = IO.read_observations_csv(spark, path)
    assert [r[0] for r in raw.orderBy("line_no").select("hour_from_admission").collect()] == [*range(400), 0]
    assert raw.filter("heart_rate IS NOT NULL").count() == 0
    from vigilia.functions import clinical as C
    assert C.with_sirs(raw).agg(F.max("sirs_score")).first()[0] == 0


def test_csv_scan_line_numbers_and_stay_rebuild(spark):
    v = T.vitals(spark, SF_SMALL)
    path = os.path.join(tempfile.mkdtemp(prefix="vigilia-csv-"), "raw")
    cols = [c.split()[0] for c in IO.OBSERVATION_SCHEMA.split(", ")]
    IO.write_table(v.orderBy("patient_id", "hour_from_admission").select(*cols).coalesce(1), path, fmt="csv")
    raw = IO.read_observations_csv(spark, path)
    assert raw.count() == 1000 and sorted(r[0] for r in raw.select("line_no").collect()) == list(range(1, 1001))
    st = STY.rebuild_stays(raw)
    assert st.select("patient_id").distinct().count() == 15  # FIXTURES.md: 15 stays at sf0.001


def test_schema_checks(spark):
    v = T.vitals(spark, SF_SMALL)
    with pytest.raises(Q.MissingColumns):
        Q.require_columns(v.drop("lactate"), ["heart_rate", "lactate"])
    assert Q.detect_column(v, K.TARGET_CANDIDATES) == "deterioration_next_12h"
    assert Q.detect_column(v, K.PATIENT_CANDIDATES) == "patient_id"
    assert P.leakage_warnings(v) == ["WARNING: sepsis_risk_score may cause data leakage"]
    from vigilia.operators import features as FE
    assert "heart_rate" in FE.numeric_columns(v) and "gender" not in FE.numeric_columns(v)


def test_prediction_log_append_partitions_by_day(spark):
    log = T.prediction_log(T.vitals(spark, SF_SMALL))
    path = tempfile.mkdtemp(prefix="vigilia-log-")
    IO.append_predictions(log, path)
    IO.append_predictions(log.limit(10), path)
    back = spark.read.parquet(path)
    assert back.count() == 1010 and "dt" in back.columns


def test_svm_calibration_rows_are_out_of_fold(spark, data, monkeypatch):
    import numpy as np
    train, held = data.filter("split_bucket < 70"), data.filter("split_bucket >= 70")
    fits = []
    real = MD.LinearSVC.fit

    def fit(self, z, *a):
        fits.append({r[0] for r in z.select("svm_fold").distinct().collect()})
        return real(self, z, *a)

    seen = []
    margins = MD.out_of_fold_margins

    def out_of_fold(z, est, folds):
        m = margins(z, est, folds)
        seen.append((z.count(), m.count()))
        return m

    monkeypatch.setattr(MD.LinearSVC, "fit", fit)
    monkeypatch.setattr(MD, "out_of_fold_margins", out_of_fold)
    m = MD.fit(train, MD.ModelSpec("svm", "rff_svm", dict(n_components=64, max_iter=8, folds=3)), K.F17, "sepsis_label")
    assert fits == [{1, 2}, {0, 2}, {0, 1}, {0, 1, 2}] and seen == [(train.count(), train.count())]
    p = MD.score(m, held, K.F17, keep=("sepsis_label",)).toPandas()
    p["p"] = p["p"].clip(1e-6, 1 - 1e-6)
    y, share = p["sepsis_label"], data.filter("split_bucket < 70").agg(F.avg("sepsis_label")).first()[0]
    loss = -(y * np.log(p["p"]) + (1 - y) * np.log(1 - p["p"])).mean()
    assert loss < -(y * math.log(share) + (1 - y) * math.log(1 - share)).mean()  # better than the training share


def test_random_features_approach_the_kernel():
    import numpy as np
    x = np.random.default_rng(3).normal(0, 1, (60, 39))
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 39)
    errors = []
    for d in (32, MD.RFF_COMPONENTS):
        z = MD.rff(x, *MD.rff_projection(39, d))
        errors.append(np.sqrt(((z @ z.T - kernel) ** 2).mean()))
    assert errors[1] < 0.07 < errors[0]


def test_grid_search_keeps_patients_together(spark, data):
    folds = data.select("patient_id", MD.patient_folds("patient_id", 3).alias("fold")).distinct()
    assert folds.count() == data.select("patient_id").distinct().count() and folds.select("fold").distinct().count() == 3
    got = MD.grouped_grid_search(data, [dict(numTrees=3, maxDepth=2, minInstancesPerNode=1), dict(numTrees=5, maxDepth=5, minInstancesPerNode=2)], K.F17, "sepsis_label", "patient_id")
    rows = got.collect()
    assert [tuple(r)[:3] for r in rows] == [(3, 2, 1), (5, 5, 2)] and all(0.5 < r.cv_auc <= 1 for r in rows)


def test_line_numbers_need_no_sort_and_bad_lines_are_kept(spark):
    path = tempfile.mkdtemp(prefix="vigilia-csv-")
    want = []
    for name, n in (("b.csv", 3000), ("a.csv", 40), ("c.csv", 1)):
        lines = [f"{i},{'oops' if i % 13 == 5 else i + 0.5}" for i in range(n)]
        with open(os.path.join(path, name), "w") as f:
            f.write("hour_from_admission,heart_rate\n" + "\n".join(lines) + "\n")
    for name, n in (("a.csv", 40), ("b.csv", 3000), ("c.csv", 1)):
        want += [(i, None if i % 13 == 5 else i + 0.5, f"{i},oops" if i % 13 == 5 else None) for i in range(n)]
    schema = "hour_from_admission long, heart_rate double"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "4096"):  # whole files, and many splits of a file
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = IO.read_observations_csv(spark, path, schema, corrupt="line")
            got = {r.line_no: (r.hour_from_admission, r.heart_rate, r.line) for r in rows.collect()}
            assert got == {k + 1: w for k, w in enumerate(want)}
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "rangepartitioning" not in plan and "Sort" not in plan
            good, bad = IO.read_with_quarantine(spark, path, schema)
            assert {(r.line_no, r.line) for r in bad.collect()} == {(k + 1, w[2]) for k, w in enumerate(want) if w[2]}
            assert good.count() == sum(w[2] is None for w in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_trees_learn_from_every_row_in_two_partitions_a_core(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    rows_of = "id", "CAST(id % 2 AS DOUBLE) AS y", "CAST(id % 7 AS DOUBLE) AS x"
    rows = spark.range(0, 1000, 1, 5 * cores).selectExpr(*rows_of)
    seen = []
    real = MD.RandomForestClassifier._fit

    def fit(self, d):
        seen.append((d.rdd.getNumPartitions(), sorted(r.id for r in d.select("id").collect())))
        return real(self, d)

    monkeypatch.setattr(MD.RandomForestClassifier, "_fit", fit)
    for d in (rows, spark.range(0, 1000, 1, 1).selectExpr(*rows_of)):
        MD.fit(d, MD.ModelSpec("rf", "rf", dict(numTrees=2, maxDepth=2), balanced=False), ["x"], "y")
    assert seen == [(2 * cores, list(range(1000))), (1, list(range(1000)))]


def test_svm_fits_read_kept_rows(spark, data, monkeypatch):
    plans = []
    real = MD.LinearSVC.fit

    def fit(self, z, *a):
        plans.append((z.rdd.getNumPartitions(), z._jdf.queryExecution().executedPlan().toString()))
        return real(self, z, *a)

    monkeypatch.setattr(MD.LinearSVC, "fit", fit)
    MD.fit(data.filter("split_bucket < 70"), MD.ModelSpec("svm", "rff_svm", dict(n_components=4, max_iter=2, folds=2)), K.F17, "sepsis_label")
    assert len(plans) == 3 and all(n == 1 and "ArrowEvalPython" not in p and "Window" not in p for n, p in plans)


def test_grid_search_prepares_a_fold_once(spark, data, monkeypatch):
    fits = []
    real = MD.MedianImputer._fit
    monkeypatch.setattr(MD.MedianImputer, "_fit", lambda self, d: fits.append(1) or real(self, d))
    grid = [dict(numTrees=2, maxDepth=2, minInstancesPerNode=1), dict(numTrees=2, maxDepth=3, minInstancesPerNode=2)]
    assert MD.grouped_grid_search(data, grid, K.F17, "sepsis_label", "patient_id", folds=2).count() == 2 and len(fits) == 2


def _kept(d):
    plan = d._jdf.queryExecution().executedPlan().toString()
    return "InMemoryTableScan" in plan or "ExistingRDD" in plan and "FileScan" not in plan


def test_a_fit_reads_kept_training_rows(spark, monkeypatch):
    from vigilia.plans import train as TR
    seen = []
    real = MD.fit

    def fit(d, spec, features, label):
        seen.append((_kept(d), d.columns, d.count()))
        return real(d, spec, features, label)

    monkeypatch.setattr(MD, "fit", fit)
    spec = MD.ModelSpec("small", "rf", dict(numTrees=2, maxDepth=2))
    data = TR.labelled_splits(spark, SF_SMALL, "sepsis_label")
    m = TR.fitted(spark, SF_SMALL, spec, "sepsis_label", K.F39, data=data)
    train = data.filter("split = 'train'").select(*K.F39, "sepsis_label")
    assert seen == [(True, [*K.F39, "sepsis_label"], train.count())] and not _kept(train)
    plain = real(train, spec, K.F39, "sepsis_label")  # the rows' partitions seed the draws: the same forest
    assert m.stages[-1].toDebugString.split("\n")[1:] == plain.stages[-1].toDebugString.split("\n")[1:]


def test_comparison_scores_kept_rows_and_matches_single_models(spark, monkeypatch):
    from vigilia.operators import metrics as M
    from vigilia.plans import train as TR
    specs = [MD.ModelSpec("lr_small", "lr", dict(maxIter=5)), MD.ModelSpec("rf_small", "rf", dict(numTrees=2, maxDepth=2)),
             MD.ModelSpec("gbt_small", "gbt", dict(maxIter=2, maxDepth=2))]
    seen = []
    real = MD.score
    monkeypatch.setattr(MD, "score", lambda model, df, *a, **kw: seen.append(_kept(df)) or real(model, df, *a, **kw))
    got = {r["model"]: r for r in TR.compare_models(spark, SF_SMALL, "sepsis_label", specs, K.F17).collect()}
    assert seen == [True] * 3 and list(sorted(got)) == ["gbt_small", "lr_small", "rf_small"]
    test = TR.labelled_splits(spark, SF_SMALL, "sepsis_label").filter("split = 'test'")
    for spec in specs:
        s = real(TR.fitted(spark, SF_SMALL, spec, "sepsis_label", K.F17), test, K.F17, keep=("sepsis_label",)).selectExpr("1 AS model", "sepsis_label AS y", "p")
        want = M.rates(M.confusion(s, ["model"])).join(M.roc_auc(M.score_curve(s, ["model"]), ["model"]), "model").first()
        assert all(got[spec.name][c] == want[c] for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))


def test_ranks_stand_for_values_at_every_split():
    import numpy as np
    rng = np.random.default_rng(4)
    thresholds = [np.arange(300) / 7.0, np.array([0.5])]  # more than a byte tells apart, and one
    tops = [TS.units(dict(left=np.array([1, -1, -1]), right=np.array([2, -1, -1]), feat=np.array([f, 0, 0]), thr=np.array([t, 0, 0]),
                          value=np.array([0, 1.0, 0]), cover=np.array([4.0, 1, 3]))) for f, c in enumerate(thresholds) for t in c]
    X = np.stack([np.concatenate([thresholds[0], [np.nan, np.inf, -np.inf], rng.normal(20, 15, 100)]), rng.choice([0.5, 0.4, 0.6, np.nan], 403)], axis=1)
    codes, cuts = TS.ranked(tops, 2)
    assert [len(c) for c in cuts] == [300, 1] and codes[299]["splits"] == [(0, 299)] and TS._width(codes[0]) == 1
    met = np.stack([(X[:, f, None] <= c).sum(axis=1) for f, c in enumerate(thresholds)], axis=1)  # NaN meets none
    want = met * 1.0 - np.array([300, 1]) / 4
    assert np.abs(TS.ranked_shap(X, codes, cuts) - want).max() < 1e-9
