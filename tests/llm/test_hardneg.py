import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from vigilia.llm import hardneg as H

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       *[T.StructField(c, T.StringType()) for c in ("v", "x", "anchor", "slot", "score", "rank")]])
EXTRA = tuple("vxasrk")


def brute(rows, wanted, positives=5, negatives=5, lower=80, upper=100):
    live = []
    for i, e, lab, *_ in rows:
        if i is not None and lab is not None and e and all(x is not None and math.isfinite(np.float32(x)) for x in e):
            v = tuple(math.floor(256 * float(np.float32(x))) for x in e)
            if sum(x * x for x in v) < 2**60:
                live.append((i, lab, v))
    out = []
    for a, lab, v in sorted({r for r in live if wanted(r[0])}):
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in live if len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == lab and s[1] != a][:positives]:
            hits = [s for s in scored if s[2] != lab and lower * -ps <= 100 * -s[0] <= upper * -ps][:negatives]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(hits)]
    return sorted(out)


def rows(seed=5, n=400, dim=5, labels=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(4)]
    out = [(i, [c + rng.gauss(0, 0.15) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]
    out += [(1000 + i, centres[0], i % 2) for i in range(60)]  # one vector many times, two labels: ties
    out += [(2000, [0.0] * dim, 1), (2001, [0.0] * dim, 2), (2100, centres[1], 77), (1000, centres[0], 0), (1000, centres[1], 0), (300, centres[2], 1)]
    out += [(3000, None, 1), (None, centres[1], 1), (3001, [], 1), (3100, [1.0, None] + [0.0] * (dim - 2), 1), (3200, [float("nan")] * dim, 1), (3300, [float("inf")] * dim, 1),
            (3400, centres[0], None), (3500, [1.0, 2.0], 1), (3501, [2.0, 1.0], 1), (3502, [2.0, 0.5], 2), (3600, [3e38] * dim, 1), (-100, centres[2], 1), (4000, [-1.0] * dim, 0), (4100, [1e6] * dim, 1)]
    return [(*r, *EXTRA) for r in out]


def test_hard_negatives_match_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    anchor = F.col("vec_id") % 100 == 0
    want = brute(data, lambda i: i % 100 == 0)
    assert len(want) > 50
    for block in (H.BLOCK, 16):  # one block, and blocks of about three anchors
        assert sorted(map(tuple, H.hard_negatives(df, anchor, block_cells=block).collect())) == want
    other = H.hard_negatives(df, anchor, positives=3, negatives=7, lower=50, upper=120)
    assert sorted(map(tuple, other.collect())) == brute(data, lambda i: i % 100 == 0, 3, 7, 50, 120)


def test_labels_may_be_an_expression_and_tables_empty(spark):
    data = rows(9, 150)
    df = spark.createDataFrame(data, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    moved = [(i, e, (lab + 1) % 10 if i is not None and lab is not None and i % 7 == 0 else lab) for i, e, lab, *_ in data]
    assert sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 50 == 0, label).collect())) == brute(moved, lambda i: i % 50 == 0)
    none = spark.createDataFrame([], SCHEMA)
    assert H.hard_negatives(none, F.lit(True)).collect() == [] and H.hard_negatives(df, F.lit(False)).collect() == []


def test_combiner_keeps_the_first_rows_of_a_group():
    rng = np.random.default_rng(2)
    group, score, ids = rng.integers(0, 7, 5000), rng.integers(-3, 4, 5000), rng.permutation(5000)
    best = H.Best(7, 4)
    for i in range(0, 5000, 333):
        best.add(group[i:i + 333], score[i:i + 333], ids[i:i + 333])
        if i % 2:
            best.settle()
    got = sorted(zip(*(a.tolist() for a in best.settle()), strict=True))
    want = sorted((g, s, i) for g in range(7) for s, i in [(-a, b) for a, b in sorted((-int(s), int(i)) for h, s, i in zip(group, score, ids, strict=True) if h == g)[:4]])
    assert got == want


def test_tiles_score_large_vectors_in_integers(spark):
    data = [(i, [2.0**19 + i, 1.0 + i], i % 2, *EXTRA) for i in range(30)]
    got = H.hard_negatives(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(data, lambda i: i % 10 == 0)
