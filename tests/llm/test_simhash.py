import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import types as T

from vigilia.llm import simhash


def brute_fp(text):
    text = "" if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, bits=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= bits:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


def test_golay_neighbours_share_a_key():
    code = simhash.Golay()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    for flips in (1, 2):
        other = words.copy()
        for i in range(len(words)):
            for bit in rng.choice(23, flips, replace=False):
                other[i] ^= 1 << bit
        keys = [set() for _ in range(2 * len(words))]
        for r, k in zip(*code.keys(np.concatenate([words, other])), strict=True):
            keys[r].add(int(k))
        assert all(keys[i] & keys[i + len(words)] for i in range(len(words)))
        assert max(map(len, keys)) <= 6
    assert len(set(code.index(np.arange(1 << 23, dtype=np.int64)).tolist())) == 1 << 12


def test_links_match_brute_force_on_both_paths(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(8):
            base ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(base)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    for hot in (512, 2):
        assert {tuple(r) for r in simhash.links(df, 2, hot).collect()} == want


def docs(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("fp", T.StringType()), T.StructField("row_key", T.StringType())])
    return spark.createDataFrame([(*r, "x", "y") for r in rows], schema)


def test_components_and_dedup_with_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60000))
    rows = [(7, "Alpha beta gamma delta"), (3, "alpha BETA gamma  delta"), (9, None), (4, ""), (4, ""), (11, "one"),
            (None, "One"), (12, long), (13, long), (13, long), (None, "a b c d e"), (20, "Émile É Z")]
    got = simhash.simhash_components(docs(spark, rows)).collect()
    fp = {t: brute_fp(t) for _, t in rows}
    comp = brute_components(set(fp.values()))
    least = {}
    for i, t in rows:
        if i is not None:
            least[comp[fp[t]]] = min(i, least.get(comp[fp[t]], i))
    want = sorted((str(i), fp[t], str(least.get(comp[fp[t]]))) for i, t in rows)
    assert sorted((str(r.doc_id), r.fp & ((1 << 64) - 1), str(r.component_id)) for r in got) == want
    kept = simhash.simhash_dedup(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "row_key"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "11", "12", "None", "20"])


def test_empty_table(spark):
    assert simhash.simhash_components(docs(spark, [])).count() == 0
    assert simhash.simhash_dedup(docs(spark, [])).count() == 0


def test_whole_table_matches_brute_force(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: brute_fp(r.text) for r in rows}
    comp = brute_components(set(fp.values()))
    least = {}
    for i, f in fp.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in E.queries()["op2_simhash"](spark, sf).collect()}
    assert got == {i: (f"{f:016x}", least[comp[f]]) for i, f in fp.items()}
