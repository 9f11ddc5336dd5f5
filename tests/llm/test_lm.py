import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import llm_odd as odd
from vigilia.llm import lm as L


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def base(rows):
    """(n_tokens, n_known, N, base score) per row, straight from the contract."""
    train = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        tokens = [*words(t), None]
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(train[w] > 0 for w in tokens), n,
                    sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return out


def check(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_base_score_matches_brute_force_with_and_without_a_head(spark):
    rows = [(r[0], r[1]) for r in odd.rows()]
    for head in (L.HEAD, 3, 1):
        got = [tuple(r)[:6] for r in L.lm_scores(odd.docs(spark), head=head).collect()]
        check(got, base(rows))
    assert L.lm_scores(odd.empty(spark)).count() == 0


def test_code_tree_is_a_prefix_code():
    counts = np.zeros(256, np.int64)
    counts[97:107] = [1000 >> i for i in range(10)]
    code = L.Code(counts)
    paths = {tuple(code.decisions(np.array([b], np.uint8))[2].tolist()) for b in range(256)}
    assert len(paths) == 256 and abs(sum(2.0 ** -len(p) for p in paths) - 1) < 1e-12
    assert not any(p != q and q[: len(p)] == p for p in paths for q in list(paths)[:40])


def plain_contexts(data, begin):
    """What a context is made of at every byte, without hashing."""
    out = []
    for i in range(begin, len(data)):
        prev = data[begin:i][::-1]
        word = data[begin:i].rpartition(b" ")[2]
        out.append(tuple((prev[:o] + b"\0" * o)[:o] if o != "word" else word for o in L.ORDERS))
    return out


def test_contexts_depend_on_the_document_alone():
    docs = [b"the cat sat \n", b"\n", b"the cat the cat \n", b"a the cat \n"]
    data, begins = L._joined(docs)
    got = np.stack(L.contexts(data, begins), axis=1)
    named = [c for d in docs for c in plain_contexts(d, 0)]
    for k in range(len(L.ORDERS)):
        table = {}
        for c, h in zip(named, got[:, k].tolist(), strict=True):
            assert table.setdefault(c[k], h) == h
        assert len(set(table.values())) == len(table)


def test_scores_are_probabilities_that_learning_improves(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()][:120]
    texts = [L.encoded(t) for _, t in rows]
    counts = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
    code = L.Code(counts)
    src = spark.createDataFrame([(t,) for _, t in rows], "text string")
    learned, blank = L.Scorer(code, L.train_table(src, code)), L.Scorer(code, np.zeros(len(L.ORDERS) << L.BITS, np.int8))
    size = sum(map(len, texts))
    assert sum(learned.bits(texts)) / size < 0.75 * sum(blank.bits(texts)) / size < 5
    assert learned.bits(texts[:5]) == learned.bits(texts)[:5]  # the neighbours in a batch don't matter
    # after any prefix the next byte's probabilities sum to one: two ways per decision do
    q = np.zeros((len(L.ORDERS), 1), np.int8)
    assert abs(sum(2.0 ** -L.mixed_bits(q, np.array([w], np.uint8)) for w in (0, 1)) - 1) < 1e-6


def slow_bits(logits, way, start):
    """The mixer decision by decision, from its definition: weights and map stand still within a block."""
    weights, apm = [[float(x) for x in row] for row in start[0]], [float(x) for x in start[1]]
    bits, begin, size = 0.0, 0, L.BLOCKS[0]
    while begin < len(way):
        part = range(begin, min(begin + size, len(way)))
        slope = [[0.0] * len(L.ORDERS) for _ in range(L.GATES)]
        hits, ones = Counter(), Counter()
        for i in part:
            x = [int(q) for q in logits[:, i]]
            gate = sum(q != 0 for q in x)
            z = max(-7.99, min(7.99, sum(w * q for w, q in zip(weights[gate], x, strict=True))))
            p = 1 / (1 + math.exp(-z))
            cell = int(z * 2 + 16.5) + gate * L.CELLS
            told = (p + apm[cell]) / 2
            bits -= math.log2(told if way[i] else 1 - told)
            for k, q in enumerate(x):
                slope[gate][k] += (int(way[i]) - p) * q
            hits[cell] += 1
            ones[cell] += int(way[i])
        rate = L.RATE / L.STEP / L.STEP / max(1.0, len(part) / 64)
        for g in range(L.GATES):
            weights[g] = [w + rate * s for w, s in zip(weights[g], slope[g], strict=True)]
        for c, n in hits.items():
            apm[c] += (1 - (1 - L.APM_RATE) ** min(n, 8)) * 0.5 * (ones[c] / n - apm[c])
        begin, size = begin + size, min(2 * size, L.BLOCKS[1])
    return bits


def test_bits_match_a_mixer_that_goes_decision_by_decision(spark):
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    code = L.Code(np.bincount(np.frombuffer(b"".join(L.encoded(t) for t in rows), np.uint8), minlength=256))
    src = spark.createDataFrame([(t,) for t in rows[:40]], "text string")
    tables = spark.sparkContext.broadcast(L.train_tables(src, code))
    start = L.learned_state(src, code, tables)
    texts = [L.encoded(t) for t in [*rows[30:], "", "a", odd.LONG[:9000]]]
    scorer = L.Scorer(code, tables.value[0], start)
    for text, got in zip(texts, scorer.bits(texts), strict=True):  # all in one call: blocks of many documents at once
        data, begins = L._joined([text])
        n, salt, way = code.decisions(data)
        logits = np.stack([scorer.table[i][L.slots(c, n, salt)] for i, c in enumerate(L.contexts(data, begins))])
        want = slow_bits(logits, way, start)
        assert abs(got - want) < 1e-3 * want + 0.01


def test_learning_counts_every_training_decision(spark):
    texts = ["abc abd abc", "xyz", "", "abc abd abc abe", "abd xyz"] * 3
    code = L.Code(np.ones(256, np.int64))
    src = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    tables = spark.sparkContext.broadcast(L.train_tables(src, code))
    counts = L._histogram(src, code, tables)
    want = Counter()
    for t in texts:
        data, begins = L._joined([L.encoded(t)])
        table = tables.value[2 - L.fold_of(L.encoded(t))].reshape(len(L.ORDERS), -1)  # the other fold's
        n, salt, way = code.decisions(data)
        x = np.stack([table[i][L.slots(c, n, salt)] for i, c in enumerate(L.contexts(data, begins))])
        for col, w in zip(x.T.tolist(), way.tolist(), strict=True):
            at = 0
            for q in col:
                at = at * L.BINS + (0 if q == 0 else (q + 128) // 16 + 1)
            want[at, w] += 1
    assert {(int(a), int(w)): int(counts[a, w]) for a, w in zip(*np.nonzero(counts), strict=True)} == dict(want)


def test_table_counts_every_training_document(spark):
    texts = ["abc abd abc", "xyz", ""]
    code = L.Code(np.ones(256, np.int64))
    src = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    table = L.train_table(src, code)
    data, begins = L._joined([L.encoded(t) for t in texts])
    n, node, way = code.decisions(data)
    for i, c in enumerate(L.contexts(data, begins)):
        ones, every = Counter(), Counter()
        for s, w in zip(L.slots(c, n, node).tolist(), way.tolist(), strict=True):
            every[s] += 1
            ones[s] += w
        for s, k in every.items():
            q = round(math.log((ones[s] + 0.4) / (k - ones[s] + 0.4)) * L.STEP)
            assert table[(i << L.BITS) + s] == (q or 1)


def test_state_is_learned_from_training_documents_and_short_texts_adapt(spark):
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()][:400]
    train, other = rows[:300], [L.encoded(t) for t in rows[300:]]
    code = L.Code(np.bincount(np.frombuffer(b"".join(L.encoded(t) for t in train), np.uint8), minlength=256))
    src = spark.createDataFrame([(t,) for t in train], "text string")
    tables = spark.sparkContext.broadcast(L.train_tables(src, code))
    start = L.learned_state(src, code, tables)
    again = L.learned_state(src.repartition(7), code, tables)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(start, again, strict=True))
    assert np.abs(start[0] - L.start_state()[0]).max() * L.STEP > 0.01
    size = sum(map(len, other))
    by_hand, learned = (sum(L.Scorer(code, tables.value[0], s).bits(other)) / size for s in (None, start))
    assert learned < by_hand
    # the state changes within a text of fewer than 2048 decisions: the same half costs less the second time
    x, way = np.full((len(L.ORDERS), 600), -24, np.int8), np.ones(600, np.uint8)
    assert L.mixed_bits(np.tile(x, 2), np.tile(way, 2)) < 1.9 * L.mixed_bits(x[:, :256], way[:256]) * 600 / 256
    # each number of seen contexts has its own weights
    assert start[0].shape == (len(L.ORDERS) + 1, len(L.ORDERS))


def test_training_counts_equal_bytes_in_equal_contexts_once(monkeypatch):
    texts = ["abc abd abc", "xyz", "", "abc abd abc abe", "\u00e9\u00ff " * 9, "abd xyz " + "q" * 70] * 5
    batches = [pd.DataFrame({"text": texts[:7]}), pd.DataFrame({"text": texts[7:]})]
    want = Counter()
    for t in map(L.encoded, texts):
        data, begins = L._joined([t])
        for at in zip(data.tolist(), *(c.tolist() for c in L.contexts(data, begins)), strict=True):
            want[L.fold_of(t), *at] += 1
    for run in (L.RUN, 40):
        monkeypatch.setattr(L, "RUN", run)
        got, rows = Counter(), 0
        for every, counts in L._tallies(batches):
            rows += len(every)
            assert (every[1:] > every[:-1]).all()
            for fold, keys, n in L._of_fold(every, counts):
                for *at, k in zip(L._byte_of(keys).tolist(), *(L._context_of(keys, i).tolist() for i in range(len(L.ORDERS))), n.tolist(), strict=True):
                    got[fold, *at] += k
        assert got == want
        assert run == 40 or rows == len(want)  # one row for each, however often it comes


def test_training_shuffles_pages(spark, monkeypatch):
    src = spark.createDataFrame([(t,) for t in ("abc abd abc", "xyz", "abd")], "text string").repartition(3)
    frame, shuffled = type(src), []
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: shuffled.append(self.count()) or real(self, *a))
    table = L.train_table(src, L.Code(np.ones(256, np.int64)))
    pages = np.count_nonzero(table.reshape(-1, L.PAGE).any(axis=1))
    assert len(shuffled) == 1 and pages <= shuffled[0] <= 3 * pages


def test_mixed_together_or_apart_is_the_same():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 255, 256, 257, 767, 768, 769, 3000, 5000, 9000, 2300, 1]
    logits = rng.integers(-40, 40, (len(L.ORDERS), sum(sizes)), np.int8)
    logits[:, rng.random(sum(sizes)) < 0.2] = 0  # contexts never seen
    way = rng.integers(0, 2, sum(sizes)).astype(np.uint8)
    ends = np.cumsum(sizes)
    weights, apm = L.start_state()
    start = weights + rng.uniform(0, 1e-3, weights.shape).astype(np.float32), apm  # no logit between two cells of the map
    alone = [L.mixed_bits(logits[:, e - n:e], way[e - n:e], start=start)[0] for n, e in zip(sizes, ends, strict=True)]
    assert np.allclose(L.mixed_bits(logits, way, sizes, start), alone, rtol=1e-6)
    assert np.allclose(alone, [slow_bits(logits[:, e - n:e], way[e - n:e], start) for n, e in zip(sizes, ends, strict=True)], rtol=1e-3, atol=0.01)
