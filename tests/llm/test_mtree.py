import math
import random

import numpy as np
from pyspark.sql import types as T
from vigilia.llm import mtree as M

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("v", T.StringType()), T.StructField("query_id", T.StringType())])


def brute(rows, wanted, k):
    live = []
    for i, e, *_ in rows:
        if i is not None and e and all(x is not None and math.isfinite(np.float32(x)) for x in e):
            live.append((i, [math.floor(1024 * float(np.float32(x))) for x in e]))
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in live if wanted(i)}):
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in live if i != q and len(w) == len(v)))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def rows(seed=3, n=500, dim=6):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    out = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], 1) for i in range(n)]
    out += [(1000 + i, centres[0], 1) for i in range(60)]  # one vector many times: ties
    out += [(2000 + i, [1.0] * dim, 1) for i in range(3)] + [(1030, centres[0], 1)]
    out += [(3000, None, 1), (None, centres[1], None), (3001, [], 1), (3100, [1.0, None] + [0.0] * (dim - 2), 1), (3200, [float("nan")] * dim, 1),
            (3300, [float("inf")] + [0.0] * (dim - 1), 1), (3400, [0.0] * dim, 1), (3500, [1.0, 2.0], 1), (3600, [2.0, 1.0], 1), (-100, centres[2], 1)]
    return [(*r, "x", "y") for r in out]


def test_top_k_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for k, shard in ((10, 64), (3, 4096), (10, None)):
        got = M.top_k(df, df.filter(M.divisible("vec_id", 100)), k, shard_rows=shard)
        assert sorted(map(tuple, got.collect())) == brute(data, lambda i: i % 100 == 0, k)


def test_empty_tables(spark):
    none, df = spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows(), SCHEMA)
    assert M.top_k(none, none).count() == 0 and M.top_k(df, none).count() == 0 and M.top_k(none, df).count() == 0


def test_tree_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.uniform(-900, 900, (40, 8))
    v = np.rint(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 20, (6000, 8))).astype(np.int64)
    top = float((v * v).sum(1).max())
    tree = M.Tree(np.arange(6000), v, top)
    for i, (centre, radius, up, a, b, kids) in enumerate(tree.nodes):
        under = [i]
        for n in under:
            under += tree.nodes[n][5]
        spans = [np.arange(*tree.nodes[n][3:5]) for n in under]
        members = np.concatenate(spans)
        assert np.sqrt(((tree.x[members] - centre) ** 2).sum(1)).max() <= radius + 1e-6
        for k in kids:
            assert abs(np.sqrt(((tree.nodes[k][0] - centre) ** 2).sum()) - tree.nodes[k][2]) < 1e-6
    search = M.Search(tree.dump())
    for q in v[:20]:
        best = sorted(((-int(x @ q), i) for i, x in enumerate(v)))[:10]
        assert sorted((-s, i) for s, i in search.query(-1, q, 10, None)) == best
    assert search.computed < 20 * 6000 / 2
    degenerate = M.Tree(np.arange(3000), np.cumsum(np.ones((3000, 1), np.int64) * 7, axis=0) ** 2, 1e12)
    assert len(degenerate.ids) == 3000
