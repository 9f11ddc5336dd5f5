import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from vigilia.llm import centroids as C

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       *[T.StructField(c, T.StringType()) for c in ("v", "x", "cluster", "near", "distance")]])
EXTRA = (1, *"vxcnd")


def kept(rows, dim, scale):
    fine = [(i, [float(np.float32(x)) for x in e]) for i, e, *_ in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(np.float32(x)) for x in e)]
    ints = [(i, tuple(math.floor(scale * x) for x in e)) for i, e in fine]
    return [(i, v) for i, v in ints if sum(x * x for x in v) < 2**60]


def brute(rows, k, rounds, dim, scale, seed):
    live = kept(rows, dim, scale)
    cs = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in live if i is not None)[:k]]
    if not cs:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in live]
        cs = [tuple(sum(col) // len(m) for col in zip(*m, strict=True)) if (m := [v for (_, v), c in zip(live, own, strict=True) if c == n]) else cs[n] for n in range(len(cs))]
    got = [(i, *near(v)) for i, v in live]
    part = {n: sum(d for _, d, c in got if c == n) for n in range(len(cs))}
    return sorted(((i, c, d, part[c], sum(part.values()), list(cs[c])) for i, d, c in got), key=repr)


def rows(dim, n=300):
    rng = random.Random(dim)
    centres = [[rng.uniform(-2, 2) for _ in range(dim)] for _ in range(5)]
    out = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(n)]
    out += [(1000 + i, centres[0]) for i in range(50)] + [(7, centres[1]), (7, centres[2]), (3, out[3][1]), (None, centres[3]), (None, centres[3])]
    out += [(2000, None), (2001, []), (2002, [1.0] * (dim + 1)), (2003, [None] + [1.0] * (dim - 1)), (2004, [float("nan")] * dim), (2005, [float("-inf")] * dim),
            (2006, [0.0] * dim), (2007, [3e38] * dim), (-5, [-1.0] * dim)]
    return [(*r, *EXTRA) for r in out]


def test_clusters_match_brute_force(spark):
    for dim, k, rounds in ((4, 6, 3), (3, 2, 0), (2, 500, 2)):
        data = rows(dim)
        got = C.clusters(spark.createDataFrame(data, SCHEMA), k, rounds, dim)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(data, k, rounds, dim, 64, 1)


def test_empty_tables_and_tables_without_ids(spark):
    assert C.clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.clusters(spark.createDataFrame([(None, [1.0, 2.0], *EXTRA)], SCHEMA), dim=2).collect() == []


def test_sums_beyond_doubles_are_exact(spark):
    big = [(i, [16000000.0 + i, -16000000.0]) for i in range(40)]
    data = [(*r, *EXTRA) for r in big]
    got = C.clusters(spark.createDataFrame(data, SCHEMA), 2, 2, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data, 2, 2, 2, 64, 1)


def test_no_python_worker_and_no_join_on_the_main_path(spark):
    vectors = C.integer_vectors(spark.createDataFrame(rows(4), SCHEMA).checkpoint(), 4)
    plan = C.assign(vectors, [[0] * 4, [1] * 4]).groupBy("cluster").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "ArrowEval" not in plan
