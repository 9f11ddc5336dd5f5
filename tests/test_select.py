"""Radix selection, splits, resampling and class weights against sorted lists; plans without sort, shuffle or writing."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vigilia.operators import prefix
from vigilia.operators import select as SE
from vigilia.operators import split as SP

SCHEMA = "label int, h double, k long, name string, wide string"


def _rows(n=900, seed=4):
    rng = random.Random(seed)
    out = [(rng.choice([0, 0, 0, 1, None]), rng.choice([None, -5.5, 0.0, float(rng.randrange(50)), rng.uniform(-9, 9)]), k, f"n{k % 7}", "x" * 50) for k in range(n)]
    return out + [(1, 3.0, (1 << 60) + k, "same", "y") for k in range(60)]  # ids that doubles don't tell apart


def _sorted(rows, g):
    mine = [r for r in rows if r[0] == g]
    return sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))


@pytest.mark.parametrize("ranges,small", [(4, 3), (16, 40), (4096, 1 << 16)])
def test_rows_at_ranks(spark, ranges, small):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    sizes, keys = SE.keys_at_ranks(df, "label", ["h", "k"], lambda n: [0, 1, n // 3, n // 2, n, n + 5], ranges, small)
    for g in (0, 1, None):
        want = _sorted(rows, g)
        n = len(want)
        assert sizes[g] == n
        assert keys[g] == [None, *[tuple(want[k - 1][1:3]) for k in (1, n // 3, n // 2, n, n)]]
    sizes, keys = SE.keys_at_ranks(df, "label", ["name", "k"], lambda n: [n // 2], ranges, small)
    assert keys[0] == [sorted((r[3], r[2]) for r in rows if r[0] == 0)[sizes[0] // 2 - 1]]
    assert SE.keys_at_ranks(df.limit(0), "label", ["h", "k"], lambda n: [1], ranges, small) == ({}, {})
    assert SE.keys_at_ranks(df, "k", ["h"], lambda n: [1]) is None


def test_split_is_the_ranked_split_without_a_shuffle(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = SP.stratified_split(df, "label", ["h", "k"])
    ranked = prefix.group_row_number(df, ["label"], ["h", "k"], "_rn", total="_n", n=5)
    want = ranked.withColumn("split", F.when(F.col("_rn") * 10000 <= F.col("_n") * 7000, "train").when(F.col("_rn") * 10000 <= F.col("_n") * 8500, "val").otherwise("test"))
    want = want.select(*got.columns)
    assert got.count() == len(rows) and got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    many = SP.stratified_split(df, "k", ["h", "name"])  # a class per row: the ranked path
    assert many.count() == len(rows)


def test_upsampling_without_a_shuffle_and_with_replacement(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("h2", SP.id_hash(F.col("k") % 100003))
    size = collections.Counter(r[0] for r in rows)
    up = SP.upsample_minority(df, "label", ["h", "k"])
    assert {r[0]: r[1] for r in up.groupBy("label").count().collect()} == dict.fromkeys(size, max(size.values()))
    per = collections.Counter((r.label, r.k) for r in up.collect())
    for g, n in size.items():
        extra = {r[2] for r in _sorted(rows, g)[:max(size.values()) % n]}
        assert all(c == max(size.values()) // n + (k in extra) for (h, k), c in per.items() if h == g)
    draws = SP.resample_minority(df, "label", ["h2", "k"])
    again = SP.resample_minority(df.repartition(7), "label", ["h2", "k"])
    assert draws.exceptAll(again).count() == 0 and again.exceptAll(draws).count() == 0
    per = collections.Counter((r.label, r.k) for r in draws.collect())
    for g, n in size.items():
        if n == max(size.values()):
            assert all(c == 1 for (h, _), c in per.items() if h == g)
            continue
        order = sorted(r[2] for r in rows if r[0] == g)
        order.sort(key=lambda k: (k % 100003 * 48271 + 11) % 10007)
        want = collections.Counter(order[int(hashlib.md5(f"42:{j}".encode()).hexdigest()[:15], 16) % n] for j in range(max(size.values())))
        assert {k: c for (h, k), c in per.items() if h == g} == want
        assert len(want) < n  # some rows are never drawn
    assert SP.resample_minority(df.limit(0), "label", ["h2", "k"]).count() == 0


def test_class_weights_keep_null_labels_and_need_no_join(spark):
    rows = _rows(200)
    df = spark.createDataFrame(rows, SCHEMA)
    got = SP.with_class_weight(df, "label")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    size = collections.Counter(r[0] for r in rows)
    assert {r[0]: round(r[1], 9) for r in got.select("label", "weight").distinct().collect()} == {g: round(len(rows) / (len(size) * n), 9) for g, n in size.items()}
    assert got.count() == len(rows)
    assert SP.with_class_weight(df, "k").count() == len(rows)  # more classes than literals


def test_quantiles_by_sketch_and_count(spark):
    import numpy as np
    import pandas as pd

    from vigilia.operators import profile as P
    rng = np.random.default_rng(5)
    n = 30000
    x = rng.normal(0, 1, n)
    frame = pd.DataFrame({"a": x, "b": rng.integers(0, 3, n).astype(float), "c": np.where(rng.random(n) < 0.4, 7.0, x * 1e9), "d": np.full(n, 2.5),
                          "e": np.where(rng.random(n) < 0.5, np.nan, x), "f": np.full(n, np.nan), "g": np.where(rng.random(n) < 0.01, np.inf, x)})
    df = spark.createDataFrame(frame).withColumn("a", F.when(F.col("a") < 2.5, F.col("a"))).withColumn("h", F.lit(None).cast("int")).cache()
    frame.loc[frame.a >= 2.5, "a"] = np.nan
    cols = list("abcdefgh")
    for q in (0.5, 0.25, 0.9, 0.0, 1.0):
        for small in (1 << 20, 50):  # one bracket, and brackets narrowed several times
            got = P.quantile_values(df, cols, q, small)
            want = {c: np.nanquantile(frame[c].to_numpy(), q) for c in "abcde"} | {"g": np.inf if q == 1 else np.nanquantile(frame.g.to_numpy(), q)}
            assert got.keys() == want.keys()
            for c in want:
                assert got[c] == want[c] or abs(got[c] - want[c]) <= 1e-12 * abs(want[c]), (c, q, small)
    assert P.exact_quantiles(df.limit(0), ["a", "b"]).count() == 0
    one = P.exact_quantiles(df, ["a", "b"]).collect()
    assert [r.feature for r in one] == ["a", "b"] and one[0].median == round(float(np.nanmedian(frame.a)), 6)
    df.unpersist()


def test_pipelines_impute_with_exact_medians(spark):
    from vigilia.operators import models as MD
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (float("nan"), 6.0), (10.0, None), (4.0, 8.0)], "a double, b double")
    got = MD.MedianImputer(["a", "b"]).fit(df).transform(df).select("a__imp", "b__imp").collect()
    assert [tuple(r) for r in got] == [(1.0, 6.0), (2.0, 4.0), (3.0, 6.0), (10.0, 6.0), (4.0, 8.0)]
