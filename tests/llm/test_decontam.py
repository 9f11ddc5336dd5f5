import itertools
import math
import random

import llm_odd as odd
from pyspark.sql import types as T
from vigilia.llm import decontam as D

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType())])


def tokens(text):
    return D.Tokens().of(text or "").tolist()


def brute(doc, items):
    """Whether some window of an item agrees in enough tokens with the document, at any alignment."""
    a = tokens(doc)
    for text in items:
        b = tokens(text)
        if len(b) < 8:  # no substitutions: in a row, and below five tokens the whole document
            if b and (a == b if len(b) < 5 else any(a[j:j + len(b)] == b for j in range(len(a)))):
                return True
            continue
        w = min(D.WINDOW, len(b))
        for i in range(len(b) - w + 1):
            for j in range(-w, len(a)):
                same = sum(0 <= j + k < len(a) and a[j + k] == b[i + k] for k in range(w))
                if same >= D.need(w):
                    return True
    return False


def test_masks_catch_every_allowed_set_of_substitutions():
    for n in range(D.MIN_TOKENS, D.WINDOW + 1):
        for bad in itertools.combinations(range(n), n - D.need(n)):
            assert any(all(c == "0" or i + j not in bad for j, c in enumerate(m)) for m in D.MASKS for i in range(n - len(m) + 1)), (n, bad)
    assert D.need(13) == 11 and D.need(8) == 7 and D.need(10) == 8 and math.isclose(D.SIMILARITY, 0.8)


def test_matches_brute_force_on_planted_and_random_texts(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(60)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [make(n) for n in (1, 3, 4, 5, 6, 7, 8, 9, 12, 13, 14, 30, 40)]
    items += [items[-1][:20] + make(5), items[-1]]
    docs = []
    for i in range(240):
        body = make(rng.randrange(0, 40))
        if i % 2:
            piece = list(rng.choice(items))
            if i % 3:
                k = rng.randrange(0, max(1, len(piece) - 14))
                piece = piece[k:k + 16]
            for _ in range(rng.randrange(0, 5)):
                piece[rng.randrange(len(piece))] = "changed" + str(rng.random())[2:]
            at = rng.randrange(0, len(body) + 1)
            body[at:at] = piece
        text = " ".join(body)
        docs.append((i, text.upper() if i % 5 == 0 else text.replace(" ", ", "), "en", "s", 0, *odd.EXTRA))
    docs += [(1000 + i, " ".join(x), "en", "s", 0, *odd.EXTRA) for i, x in enumerate(x for t in items[:6] for x in (t, t[:-1] + ["other"], [*t, "more"]))]
    bench = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(items)] + [(None, None, None), (99, "", None)], ITEMS)
    want = {d[0]: brute(d[1], [" ".join(t) for t in items]) for d in docs}
    df = odd.docs(spark, docs)
    assert 20 < sum(want.values()) < 240
    for limit in (D.BLOCK_TOKENS, 25):  # one block, and many
        got = {r.doc_id: r for r in D.contamination(df, bench, limit=limit).collect()}
        assert {i: r.contaminated for i, r in got.items()} == want
        assert all((r.n_spans > 0) == r.contaminated == (r.item_id is not None) for r in got.values())
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, bad in want.items() if not bad}


def test_odd_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(None, "no id here at all my friend of old", "x"), (5, odd.LONG, "x"), (6, odd.LONG, "x")], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    df = odd.docs(spark)
    got = D.contamination(df, bench).collect()
    assert len(got) == len(odd.rows())
    assert sorted((r.doc_id, r.item_id) for r in got if r.contaminated) == [(4, 5), (4, 5)]
    assert D.decontaminate(df, none).count() == len(odd.rows())
    assert D.contamination(odd.empty(spark), bench).count() == 0
