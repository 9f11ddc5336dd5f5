"""Exact removal of repeated 200-byte strings with suffix arrays.

A byte goes if a string of ``WINDOW`` bytes that covers it starts anywhere else too. Every string of that length (a
*window*) is given the smallest hash of its ``GRAM``-byte substrings: equal windows have equal hashes, and consecutive
windows of a text mostly share one, so a text is cut into *runs* of windows with a common hash. Windows can only be
equal if their runs' hashes are, so runs whose hash comes up once (and once in their own run) are done with, after one
count by hash: no text moves for them.

Of the other runs, each distinct content (by 64-bit hash, with its number of occurrences) is fetched once and dealt to
a *shard* by its run hash. Per shard the contents are joined and their suffix array is built in numpy by
Larsson-Sadakane refinement: suffixes sorted by their first symbols, then only groups that are still tied are sorted
by the rank of the suffix twice as far on, until none is. Kasai's method gives the common prefixes, along all contents
in step (the prefix of the next position is at least one shorter); a window that shares ``WINDOW`` symbols with its
neighbour in the array is repeated, and so are all windows of a content that occurs twice. A run hash with more than
``PER_KEY`` distinct contents (the edited copies of one passage) is spread over several shards. Those hand on the
sorted hashes of their distinct windows in bins, and each bin is merged across shards by binary search.

The verdicts go back to all occurrences of the contents, and each document is cut in one pass.

Cases: null texts are empty; texts shorter than a window lose nothing; a null id is an id like any other; rows that
repeat are documents of their own, so they lose what they share; long periodic texts are cut into runs of at most
``LONGEST`` windows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm import common

WINDOW = 200
GRAM = 32
LONGEST = 512  # windows of a run
PIECE = 1 << 20  # bytes hashed at a time
SHARD_BYTES = 1 << 20
PER_KEY = 2048  # distinct contents of a run hash in one shard
RUN = "h long, ck long, key long, lo long, n int, multi boolean"
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 200) for b in range(256)], _U)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


class Hashes:
    """Rolling hashes of the substrings of a byte array, from running sums."""

    _powers = np.ones(1, _U)
    _inverse = np.ones(1, _U)

    def __init__(self, data: np.ndarray):
        if len(self._powers) < len(data):
            n = len(data)
            Hashes._powers = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n - 1, _BASE, _U))])
            Hashes._inverse = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n - 1, pow(_BASE, -1, 1 << 64), _U))])
        self.total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[data] * self._powers[: len(data)])])

    def all(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return _mixed((self.total[size:] - self.total[:n]) * self._inverse[:n])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.total[b] - self.total[a]) * self._inverse[a] + (b - a).astype(_U) * _U(_BASE >> 3 | 1))


def sliding(x: np.ndarray, w: int, pick: np.ufunc, edge: int) -> np.ndarray:
    """pick over x[i:i + w] for every i: running picks from both ends of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-len(x) % w, edge, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    head = pick.accumulate(blocks, axis=1).ravel()
    tail = np.ascontiguousarray(pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return pick(tail[:n], head[w - 1:w - 1 + n])


def text_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, lo, n, h, ck, multi) of the runs of all windows of ``texts``."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    w = WINDOW - GRAM + 1
    if len(data) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U, bool))
    hashes = Hashes(data)
    gram = hashes.all(GRAM)
    least = sliding(gram, w, np.minimum, np.iinfo(_U).max)  # per window start
    count = np.maximum(0, size - WINDOW + 1)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    m = least[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (m[1:] != m[:-1]) | (owner[1:] != owner[:-1])
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    fresh |= (np.arange(len(at)) - lead) % LONGEST == 0
    first = np.nonzero(fresh)[0]
    n = np.diff(np.append(first, len(at)))
    lo = at[first]
    # run hashes that stand at two places of one text near each other
    valid = np.zeros(len(least), _U)
    valid[at] = m
    edge = np.zeros(w - 1, _U)
    most = sliding(np.concatenate([edge, valid, edge]), w, np.maximum, 0)  # over the windows that hold each gram
    anchors = np.nonzero(most[: len(gram)] == gram)[0]
    twice = gram[anchors[1:]][gram[anchors[1:]] == gram[anchors[:-1]]]
    multi = np.isin(m[first], twice) | (n > w)
    return owner[first], lo - begin[owner[first]], n, m[first], hashes.of(lo, lo + n + WINDOW - 1), multi


def _groups(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(row numbers, offsets, pieces) of about PIECE bytes; a longer text is cut into pieces that overlap by a window."""
    rows, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            rows.append(i)
            offsets.append(a)
            parts.append(t[a:a + PIECE + WINDOW - 1])
            size += len(parts[-1])
            if size >= PIECE:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
    if rows:
        yield rows, offsets, parts


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, text) with key a hash of id and text."""
    return common.id_text(docs, id_col, text_col).withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))


def runs(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = b["key"].to_numpy(np.int64)
            for row, offset, parts in _groups([t.encode("utf-8", "replace") for t in b["text"]]):
                owner, lo, n, h, ck, multi = text_runs(parts)
                yield pd.DataFrame({"h": h.view(np.int64), "ck": ck.view(np.int64), "key": keys[np.array(row)[owner]],
                                    "lo": lo + np.array(offset)[owner], "n": n.astype(np.int32), "multi": multi})

    return rows.select("key", "text").mapInPandas(run, RUN)


SYMBOL_BITS, SYMBOLS = 9, 7  # symbols (byte + 1; 0 between contents) packed into one sort key


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, rank, packed symbols): Larsson-Sadakane refinement of the order by the first symbols."""
    n = len(symbols)
    wide = np.concatenate([symbols, np.zeros(SYMBOLS, symbols.dtype)]).astype(np.int64)
    packed = np.zeros(n, np.int64)
    for k in range(SYMBOLS):
        packed = packed << SYMBOL_BITS | wide[k:k + n]
    sa = np.argsort(packed, kind="stable")
    key = packed[sa]
    place = np.arange(n)
    rank = np.empty(n + 1, np.int64)

    def leaders(fresh: np.ndarray, where: np.ndarray) -> np.ndarray:
        """First place of each suffix's group."""
        return np.maximum.accumulate(np.where(fresh, where, 0))

    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    rank[sa], rank[n] = leaders(fresh, place), -1
    tied = np.nonzero(~(fresh & np.append(fresh[1:], True)))[0]  # places in groups of two or more
    depth = SYMBOLS
    while len(tied):
        suffix = sa[tied]
        group, further = rank[suffix], rank[np.minimum(suffix + depth, n)]
        pair = group * (n + 1) + further + 1
        order = np.argsort(pair, kind="stable")
        suffix, pair, group = suffix[order], pair[order], group[order]
        sa[tied] = suffix  # groups stay in place: tied places ascend and so do groups
        fresh = np.ones(len(tied), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[suffix] = leaders(fresh, tied)
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return sa, rank[:n], packed


def common_prefixes(sa: np.ndarray, rank: np.ndarray, packed: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kasai: (position, neighbour before it in the array, common prefix up to WINDOW) for the first n positions of
    every content, all contents in step: going one on loses at most one symbol of the prefix."""
    size = len(sa)
    order = np.argsort(-n, kind="stable")
    start, n = start[order], n[order]
    known = np.zeros(len(start), np.int64)
    wide = np.concatenate([packed, np.full(WINDOW + SYMBOLS, -1, np.int64)])
    wide_other = np.concatenate([packed, np.full(WINDOW + SYMBOLS, -2, np.int64)])
    for t in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -t, "left"))  # contents with more than t windows
        i = start[:live] + t
        before = rank[i] - 1
        j = np.where(before >= 0, sa[before], size)
        length = np.maximum(known[:live] - 1, 0)
        length[before < 0] = 0
        go = np.nonzero(before >= 0)[0]
        while len(go):
            a, b = wide[i[go] + length[go]], wide_other[j[go] + length[go]]
            same = a == b
            stop = ~same
            if stop.any():
                x = a[stop] ^ b[stop]
                x[(a[stop] < 0) | (b[stop] < 0)] = np.int64(1) << np.int64(62)
                length[go[stop]] += sum((x < np.int64(1) << np.int64(SYMBOL_BITS * (SYMBOLS - k))).astype(np.int64) for k in range(1, SYMBOLS))
            length[go[same]] += SYMBOLS
            go = go[same & (length[go] < WINDOW)]
        known[:live] = np.minimum(length, WINDOW)
        yield i, j, known[:live].copy()


def repeated_windows(contents: list[bytes]) -> list[np.ndarray]:
    """For each content, which of its windows starts at another place of any content too."""
    symbols = np.concatenate([x for c in contents for x in (np.frombuffer(c, np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16))])
    size = np.array([len(c) for c in contents], np.int64)
    start = np.cumsum(size + 1) - (size + 1)
    sa, rank, packed = suffix_array(symbols)
    hit = np.zeros(len(symbols) + 1, bool)
    for i, j, length in common_prefixes(sa, rank, packed, start, size - WINDOW + 1):
        full = length >= WINDOW
        hit[i[full]] = True
        hit[j[full]] = True
    return [hit[a:a + n] for a, n in zip(start, size - WINDOW + 1, strict=True)]


def spans_of(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


SPANS = "array<struct<a:int,b:int>>"


def _shards(contents: DataFrame) -> DataFrame:
    """Verdicts (kind 0: h, ck, spans) and, for run hashes on several shards, sorted window hashes per bin (kind 1)."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        texts = list(part["content"])
        hits = repeated_windows(texts)
        rows, spread = [], {}
        for h, ck, cnt, parts, salt, text, hit in zip(part["h"], part["ck"], part["cnt"], part["parts"], part["salt"], texts, hits, strict=True):
            if cnt > 1:
                hit[:] = True
            if hit.any():
                rows.append((0, h, ck, spans_of(hit), 0, 0, None, None, None))
            if parts > 1:
                w = Hashes(np.frombuffer(text, np.uint8)).all(WINDOW)
                spread.setdefault((h, parts, salt), []).append((w, np.full(len(w), ck), np.where(hit, -1, np.arange(len(w))).astype(np.int32)))
        for (h, parts, salt), found in spread.items():
            w, ck, rel = (np.concatenate(x) for x in zip(*found, strict=True))
            w, at = np.unique(w, return_index=True)
            bins = (w % _U(parts)).astype(np.int64)
            for x in range(parts):
                pick = np.nonzero(bins == x)[0]
                rows.append((1, h, 0, None, x, salt, w[pick].tobytes(), ck[at[pick]].astype(np.int64).tobytes(), rel[at[pick]].tobytes()))
        return pd.DataFrame(rows, columns=["kind", "h", "ck", "spans", "bin", "salt", "windows", "cks", "rels"])

    schema = f"kind int, h long, ck long, spans {SPANS}, bin int, salt int, windows binary, cks binary, rels binary"
    return contents.groupBy("shard").applyInPandas(run, schema)


def _merged(sorted_runs: DataFrame) -> DataFrame:
    """(h, ck, spans) of windows that stand in two shards: binary search of each sorted run in the others."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        got = [(np.frombuffer(w, _U), np.frombuffer(c, np.int64), np.frombuffer(r, np.int32)) for w, c, r in zip(part["windows"], part["cks"], part["rels"], strict=True)]
        rows = []
        every = np.zeros(0, _U)
        seen = np.zeros(0, np.int64)
        for w, _, _ in got:  # merge run after run: how many runs hold each window
            at = np.searchsorted(every, w)
            known = (at < len(every)) & (every[np.minimum(at, len(every) - 1)] == w) if len(every) else np.zeros(len(w), bool)
            seen[at[known]] += 1
            every, seen = np.insert(every, at[~known], w[~known]), np.insert(seen, at[~known], 1)
        for w, c, r in got:
            both = (seen[np.searchsorted(every, w)] > 1) & (r >= 0)
            for ck in np.unique(c[both]):
                hit = np.zeros(int(r[both & (c == ck)].max()) + 1, bool)
                hit[r[both & (c == ck)]] = True
                rows.append((int(part["h"].iloc[0]), int(ck), spans_of(hit)))
        return pd.DataFrame(rows, columns=["h", "ck", "spans"])

    return sorted_runs.groupBy("h", "bin").applyInPandas(run, f"h long, ck long, spans {SPANS}")


def repeated(rows: DataFrame, per_key: int = PER_KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, spans): ranges of window starts of each document that are repeated somewhere."""
    every = runs(rows)
    again = every.groupBy("h").agg(F.count("*").alias("n"), F.max("multi").alias("multi")).filter("n > 1 or multi").select("h")
    some = common.write_cut(every.drop("multi").join(again, "h", "left_semi"))
    distinct = some.groupBy("h", "ck").agg(F.count("*").alias("cnt"), F.min(F.struct("key", "lo", "n")).alias("at"))
    load = distinct.groupBy("h").agg(F.ceil(F.count("*") / per_key).cast("int").alias("parts")).filter("parts > 1")
    distinct = common.write_cut(distinct.join(load, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1))))
    total = distinct.agg(F.sum(F.col("at.n") + WINDOW)).first()[0] or 0
    wanted = distinct.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct("h", "ck", "cnt", "parts", F.col("at.lo").alias("lo"), F.col("at.n").alias("n"))).alias("wanted"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, asked in zip(b["text"], b["wanted"], strict=True):
                data = text.encode("utf-8", "replace")
                out += [(r["h"], r["ck"], r["cnt"], r["parts"], data[r["lo"]:r["lo"] + r["n"] + WINDOW - 1]) for r in asked]
            yield pd.DataFrame(out, columns=["h", "ck", "cnt", "parts", "content"])

    contents = rows.join(wanted, "key").select("text", "wanted").mapInPandas(fetch, "h long, ck long, cnt long, parts int, content binary")
    buckets = max(1, -(-total // shard_bytes))
    salt = F.pmod(F.xxhash64("ck"), "parts").cast("int")
    contents = contents.withColumn("salt", salt).withColumn("shard", F.pmod(F.xxhash64("h", "salt"), F.lit(buckets)))
    found = common.write_cut(_shards(contents))
    verdicts = found.filter("kind = 0").select("h", "ck", "spans").unionByName(_merged(found.filter("kind = 1").select("h", "bin", "windows", "cks", "rels")))
    spans = some.join(verdicts, ["h", "ck"]).select("key", F.explode("spans").alias("s"), "lo")
    return spans.groupBy("key").agg(F.collect_list(F.struct((F.col("lo") + F.col("s.a")).alias("a"), (F.col("lo") + F.col("s.b")).alias("b"))).alias("spans"))


def cut(data: bytes, spans) -> tuple[bytes, int]:
    """(text without the bytes that windows starting in ``spans`` cover, number of maximal removed runs)."""
    gone: list[list[int]] = []
    for a, b in sorted((int(s["a"]), int(s["b"]) - 1 + WINDOW) for s in spans):
        if gone and a <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], b)
        else:
            gone.append([a, b])
    edges = [0, *(x for g in gone for x in g), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(gone)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **limits) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row; ``kept`` holds the remaining bytes."""
    rows = keyed(docs, id_col, text_col)
    spans = repeated(rows, **limits)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, found in zip(b["text"], b["spans"], strict=True):
                data = text.encode("utf-8", "replace")
                kept, n = cut(data, [] if found is None else found)
                out.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
            got = pd.DataFrame(out, columns=names)
            got.insert(0, "doc_id", b["doc_id"].reset_index(drop=True))
            yield got

    joined = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
