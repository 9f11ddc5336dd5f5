import hashlib
import random
from collections import Counter

import numpy as np
import llm_odd as odd
from vigilia.llm import suffix as S

W = S.WINDOW


def brute(texts):
    """(bytes left, removed runs) of every text: bytes covered by a window that stands at two places or more."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + W] for d in data for i in range(len(d) - W + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - W + 1):
            if count[d[i:i + W]] > 1:
                gone[i:i + W] = True
        out.append((bytes(b for b, g in zip(d, gone, strict=False) if not g), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())))
    return out


def expect(ids, texts):
    return sorted((str(i), len((t or "").encode()), len((t or "").encode()) - len(kept), n, hashlib.sha256(kept).hexdigest())
                  for i, t, (kept, n) in zip(ids, texts, brute(texts), strict=True))


def got(df, **limits):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(df, **limits).collect())


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(80), prose(45), "Was. " * 120, "é" * 150]
    out = [prose(rng.randrange(0, 120)) for _ in range(25)]
    for _ in range(40):
        p = rng.choice(shared)
        a = rng.randrange(0, max(1, len(p) - 150))
        out.append(prose(rng.randrange(0, 30)) + p[a:a + rng.randrange(150, 500)] + prose(rng.randrange(0, 30)))
    one = prose(300)
    for _ in range(30):  # copies with an edit each
        at = rng.randrange(len(one))
        out.append(one[:at] + word() + one[at:])
    return [*out, out[0], out[1], out[1], "x" * 199, "y" * 200, "z" * 201, "ab" * 300, one, "Was. " * 60, None, ""]


def test_matches_brute_force_on_one_and_many_shards(spark):
    for seed, limits in ((1, {}), (2, {"per_key": 2, "shard_bytes": 4096}), (3, {"per_key": 1})):
        t = texts(seed)
        df = odd.docs(spark, [(i, x, None, None, 0, *odd.EXTRA) for i, x in enumerate(t)])
        assert got(df, **limits) == expect(range(len(t)), t)


def test_odd_rows(spark):
    rows = odd.rows()
    assert got(odd.docs(spark)) == expect([r[0] for r in rows], [r[1] for r in rows])
    assert S.suffix_dedup(odd.empty(spark)).count() == 0


def test_whole_table_matches_brute_force(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = E.queries()["op3_suffix_dedup"](spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == expect([r.doc_id for r in rows], [r.text for r in rows])


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    rng = random.Random(9)
    t = bytes(rng.randrange(97, 105) for _ in range(5000)) * 2
    monkeypatch.setattr(S, "PIECE", 700)
    seen = np.zeros(len(t) - W + 1, int)
    for row, offset, parts in S._groups([t]):
        owner, lo, n, h, ck, multi = S.text_runs(parts)
        for o, a, k in zip(owner, lo, n, strict=True):
            seen[a + offset[o]:a + offset[o] + k] += 1
    assert (seen == 1).all()


def test_suffix_array_and_common_prefixes():
    rng = random.Random(4)
    for alphabet, n in (("ab", 400), ("abcdefgh", 3000), ("a", 300)):
        data = np.array([ord(rng.choice(alphabet)) for _ in range(n)], np.int16)
        data[rng.randrange(n)] = 0
        sa, rank, packed = S.suffix_array(data)
        listed = data.tolist()
        assert sa.tolist() == sorted(range(n), key=lambda i: listed[i:])
        for i, j, length in S.common_prefixes(sa, rank, packed, np.array([0]), np.array([n])):
            for p, q, k in zip(i.tolist(), j.tolist(), length.tolist(), strict=True):
                if rank[p]:
                    true = next((x for x in range(min(n - p, n - q)) if listed[p + x] != listed[q + x]), min(n - p, n - q))
                    assert min(k, n - max(p, q)) == min(true, W)
