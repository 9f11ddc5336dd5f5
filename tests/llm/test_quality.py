import math

import numpy as np
import llm_odd as odd
from pyspark.sql import functions as F
from vigilia.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x, bags, y = rng.random((9, Q.FEATURES)), np.array([4, 1, 4]), np.array([1.0, 0.0, 1.0])
    m = Q.train([x[:4], x[4:5], x[5:]], y, epochs=1)
    loss = lambda m: -np.mean(np.log(np.where(y > 0, (s := Q.forward(m, x, bags)["score"]), 1 - s)))
    g = Q._gradient(m, x, bags, y)
    for name in ("W", "V", "U", "w", "c", "b"):
        at = tuple(0 for _ in m[name].shape)
        up, down = {**m, name: m[name].copy()}, {**m, name: m[name].copy()}
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[name][at]) < 1e-6, name


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality_scores(docs, Q.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.001/" + f"{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(Q.remainder("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, labels), Q.fit(docs, other)
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (None, 0, "c"), (4, 0, "d"), (104, None, "e"), (999999, 1, "f"), (101, 1, "g"), (102, 1, "g")], "doc_id long, quality int, text string")
    df = odd.docs(spark)
    m = Q.fit(df, labels)
    got = Q.quality_scores(df, m).collect()
    assert len(got) == len(odd.rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out is not None for r in got)
    kept = Q.keep_good(df, m)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.predicted)
    assert Q.fit(df, labels.limit(0)) == {"constant": 0.5} and 0 < Q.fit(df, labels.filter("quality = 1"))["constant"] < 1
    assert Q.quality_scores(odd.empty(spark), m).count() == 0 and Q.keep_good(odd.empty(spark), m).count() == 0


def test_whole_texts_are_read():
    good = "Inther wonde of the stand, and erelin touse binder. " * 2000
    words = Q._Words()
    x, bags = Q.passages([good, "", good + "$$$ %%% ###"], words)
    assert bags.tolist() == [-(-18000 // 64), 1, -(-18003 // 64)] and not np.array_equal(x[bags[0] - 1], x[-1]) and not x[bags[0]].any()
    bulk = [good[: 37 * i] for i in range(40)]
    one = np.concatenate([Q.passages([t], words)[0] for t in bulk])
    assert np.allclose(one, Q.passages(bulk, words)[0])


def test_learning_reads_every_passage_within_its_bounds(spark, monkeypatch):
    words = [f"w{i % 97}x{i % 89}" for i in range(20000)]
    docs = odd.docs(spark, [(i, " ".join(words[i:]), "en", "s", 0, *odd.EXTRA) for i in (3, 4)] + [(i, "short text", "en", "s", 0, *odd.EXTRA) for i in (6, 6, 7)])
    labels = spark.createDataFrame([(i, i % 2) for i in (3, 4, 6, 7)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "train", lambda bags, y: seen.append((bags, y)) or {"constant": 0.5})
    ids = {r.doc_id for r in labels.filter(Q.remainder("doc_id") != 0).collect()}
    size = {i: 313 if i < 5 else 1 for i in (3, 4, 6, 7)}
    Q.fit(docs, labels)
    assert sorted(len(x) for x in seen[0][0]) == sorted(size[i] for i in ids)  # whole texts; the repeated row once
    Q.fit(docs, labels, passage_limit=2)
    assert [len(x) for x in seen[1][0]] == [1] * sum(i > 5 for i in ids)
    Q.fit(docs, labels, sample=1)
    assert len(seen[2][0]) == 1


def test_scores_equal_a_plain_forward_pass(spark):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.001/" + f"{t}.parquet") for t in ("documents", "labels"))
    m = Q.fit(docs, labels)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in Q.quality_scores(docs, m).collect():
        split = text[r.doc_id].split()
        hidden, weight = [], []
        for i in range(0, max(1, len(split)), Q.PASSAGE):
            x, _ = Q.passages([" ".join(split[i:i + Q.PASSAGE])], Q._Words())
            h = [math.tanh(sum((x[0][k] - m["mean"][k]) / m["std"][k] * m["W"][k][j] for k in range(Q.FEATURES)) + m["b"][j]) for j in range(Q.HIDDEN)]
            e = 0.0
            for g in range(Q.GATE):
                v = sum(h[j] * m["V"][j][g] for j in range(Q.HIDDEN)) + m["bv"][g]
                u = sum(h[j] * m["U"][j][g] for j in range(Q.HIDDEN)) + m["bu"][g]
                e += m["w"][g] * math.tanh(v) / (1 + math.exp(-u))
            hidden.append(h)
            weight.append(math.exp(e))
        z = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(Q.HIDDEN)]
        want = 1 / (1 + math.exp(-(sum(z[j] * m["c"][j] for j in range(Q.HIDDEN)) + m["d"])))
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.3)
