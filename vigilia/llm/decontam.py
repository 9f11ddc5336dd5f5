"""Benchmark decontamination by spaced-seed hashing.

Tokens are words in lower case without punctuation at their ends. Fixed masks (``MASKS``, 1 = token used, 0 = position
ignored) give each position of a text one hash per mask; equal hashes of a benchmark item and a document are a hit,
also where the ignored tokens differ. Around each hit both texts are laid on the hit's diagonal: the document is
contaminated if some window of ``WINDOW`` tokens of the item (the whole item, if it is shorter) agrees with the
document in at least ``SIMILARITY`` of its tokens. The masks catch every window of 8 to 13 tokens with the one or two
substitutions that this allows (tests/llm checks all of them). Shorter items have no room for substitutions: an item of
5 to 7 tokens is found where all its tokens stand in a row (the mask without gaps hits there), and one of 1 to 4 tokens
where it is the whole document, since its words in a row are no copy of it yet.

The benchmark is the query set: it is read in blocks of at most ``BLOCK_TOKENS`` tokens, each broadcast as sorted
hashes with positions (about 40 MB at most, whatever the benchmark's size), and every document is held against each
block in whole. Benchmark positions whose surroundings are equal for the whole reach of the check are kept once, so a
passage that many items share is one entry.

Cases: null and empty texts hold nothing, and items without a token (null, empty, punctuation) are in nothing;
repeated rows get the same verdict each; a null id is an id like any other; empty tables give no contamination;
extra columns are ignored (``contamination``) or kept (``decontaminate``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm import common

MASKS = ("11111", "1101011", "10110011")  # five tokens each
WINDOW = 13
SIMILARITY = 0.8
MIN_TOKENS = 8  # shorter items are found as whole sequences only
SEED_TOKENS = 5  # shorter ones have no seed
BLOCK_TOKENS = 1 << 20
SPAN = max(map(len, MASKS))
REACH = np.arange(-WINDOW + 1, SPAN + WINDOW - 1)  # offsets from a hit that a window over it can touch
FILTER_BITS = 24
SEED = 11
_MIX = np.array([xxhash.xxh64_intdigest(str(i), 77) | 1 for i in range(len(REACH) + 16)], np.uint64)


class Tokens(dict):
    """raw word -> hash of the word without punctuation at its ends; 0 if nothing is left."""

    LIMIT = 1 << 19

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        core = word.strip("".join({c for c in word if not c.isalnum()})) if not word.isalnum() else word
        h = self[word] = (xxhash.xxh64_intdigest(core.encode("utf-8", "replace"), SEED) | 1) if core else 0
        return h

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return h[h != 0]


def need(n: int) -> int:
    """Tokens that must agree in a window of n."""
    return int(np.ceil(SIMILARITY * n - 1e-9))


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask laid on every position where it fits."""
    size = len(tokens) - len(mask) + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, xxhash.xxh64_intdigest(mask, 3), np.uint64)
    for i, used in enumerate(mask):
        if used == "1":
            out = (out ^ tokens[i:i + size]) * _MIX[i]
            out ^= out >> np.uint64(29)
    return out


def _whole(tokens: np.ndarray) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), SEED))


class Block:
    """Seeds of some benchmark items: sorted hashes, the position each stands for, and a bit filter before the search."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1].tobytes()))
        pad = np.zeros(len(REACH), np.uint64)  # 0 stands between items, and no token is 0
        sizes = [len(t) for _, t in items]
        self.tokens = np.concatenate([pad, *[y for _, t in items for y in (t, pad)]])
        self.low = np.zeros(len(self.tokens), np.int32)
        self.high = np.zeros(len(self.tokens), np.int32)
        self.item = np.zeros(len(self.tokens), np.int64)
        self.named = np.zeros(len(self.tokens), bool)
        at = len(pad)
        for (name, _), n in zip(items, sizes, strict=True):
            self.low[at:at + n], self.high[at:at + n] = at, at + n
            self.item[at:at + n], self.named[at:at + n] = (name or 0), name is not None
            at += n + len(pad)
        context = np.zeros(len(self.tokens), np.uint64)
        for j, off in enumerate(REACH):
            context += np.roll(self.tokens, -off) * _MIX[j]
        hashes, places = [], []
        for mask in MASKS:
            h = seeds(self.tokens, mask)
            inside = np.nonzero((self.high[:len(h)] > 0) & (np.arange(len(h)) + len(mask) <= self.high[:len(h)]))[0]
            hashes.append(h[inside])
            places.append(inside)
        h, p = np.concatenate(hashes), np.concatenate(places)
        order = np.lexsort((p, context[p], h))
        h, p = h[order], p[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (context[p][1:] != context[p][:-1])
        self.hash, self.place = h[first], p[first].astype(np.int32)
        starts = len(pad) + np.cumsum([0, *(n + len(pad) for n in sizes[:-1])]) if sizes else np.zeros(0, np.int64)
        tiny = [int(at) for at, n in zip(starts, sizes, strict=True) if n < SEED_TOKENS]
        whole = np.array([_whole(self.tokens[at:self.high[at]]) for at in tiny], np.uint64)
        order = np.argsort(whole, kind="stable")
        self.whole, self.whole_place = whole[order], np.array(tiny, np.int32)[order]

    def filter(self) -> np.ndarray:
        out = np.zeros(1 << FILTER_BITS, bool)
        out[self.hash >> np.uint64(64 - FILTER_BITS)] = True
        return out

    def windows(self, doc: np.ndarray, at: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end in doc, place) of every window that agrees well enough on the diagonals of hits."""
        for i in range(0, len(at), 4096):
            a, p = at[i:i + 4096, None], place[i:i + 4096, None].astype(np.int64)
            low, high = self.low[p], self.high[p]
            ref, pos = p + REACH, a + REACH
            inside = (ref >= low) & (ref < high) & (pos >= 0) & (pos < len(doc))
            same = inside & (self.tokens[np.clip(ref, 0, len(self.tokens) - 1)] == doc[np.clip(pos, 0, len(doc) - 1)])
            total = np.concatenate([np.zeros((len(a), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
            span = total[:, WINDOW:] - total[:, :-WINDOW]
            start = ref[:, : span.shape[1]]
            good = (span >= need(WINDOW)) & (start >= low) & (start + WINDOW <= high)
            for r, c in zip(*np.nonzero(good), strict=True):
                yield int(pos[r, c]), int(pos[r, c]) + WINDOW, int(p[r, 0])
            size = (high - low)[:, 0]
            least = np.where(size < MIN_TOKENS, size, np.ceil(SIMILARITY * size - 1e-9))
            whole = (size < WINDOW) & (total[:, -1] >= least)
            for r in np.nonzero(whole)[0]:
                begin = int(a[r, 0] - (p[r, 0] - low[r, 0]))
                yield max(0, begin), min(len(doc), begin + int(size[r])), int(p[r, 0])

    def check(self, doc: np.ndarray, maybe: np.ndarray) -> tuple[list[tuple[int, int]], int | None]:
        """(merged contaminated token spans, smallest item seen) of one document."""
        spans, items = set(), set()
        if 0 < len(doc) < SEED_TOKENS:
            h = _whole(doc)
            for p in self.whole_place[np.searchsorted(self.whole, h, "left"):np.searchsorted(self.whole, h, "right")]:
                if np.array_equal(self.tokens[p:self.high[p]], doc):
                    spans.add((0, len(doc)))
                    if self.named[p]:
                        items.add(int(self.item[p]))
        for mask in MASKS:
            h = seeds(doc, mask)
            at = np.nonzero(maybe[h >> np.uint64(64 - FILTER_BITS)])[0]
            if not len(at):
                continue
            left, right = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            n = right - left
            if not n.sum():
                continue
            hit = np.repeat(at, n)
            entry = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for a, b, p in self.windows(doc, hit, self.place[entry]):
                spans.add((a, b))
                if self.named[p]:
                    items.add(int(self.item[p]))
        return merged(spans), min(items, default=None)


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_TOKENS) -> Iterator[Block]:
    """The benchmark a partition at a time, in blocks of at most ``limit`` tokens (one longer item is cut into
    overlapping stretches, so that every window of it is in one of them)."""
    tokens, held, size = Tokens(), [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("item"), common.text_of(text_col).alias("text")).toLocalIterator():
        t = tokens.of(r["text"])
        if not len(t):
            continue
        for i in range(0, max(1, len(t) - WINDOW + 1), limit):
            part = t[i:i + limit + WINDOW - 1]
            if held and size + len(part) > limit:
                yield Block(held)
                held, size = [], 0
            held.append((r["item"], part))
            size += len(part)
    if held:
        yield Block(held)


def flagged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", limit: int = BLOCK_TOKENS) -> DataFrame:
    """(key, item_id, spans) per contaminated (id, text): spans are merged [start, end) token ranges."""
    spark = docs.sparkSession
    src = docs.select(common.row_key(F.col(id_col), common.text_key(text_col)).alias("key"), common.text_of(text_col).alias("text"))
    schema = "key string, item_id long, spans array<struct<start:int,end:int>>"
    parts = [spark.createDataFrame([], schema)]
    for block in blocks(benchmark, item_col, item_text_col, limit):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tokens, block = Tokens(), shared.value
            maybe = block.filter()
            for b in batches:
                rows = []
                for key, text in zip(b["key"], b["text"], strict=True):
                    spans, item = block.check(tokens.of(text), maybe)
                    if spans:
                        rows.append((key, item, [{"start": x, "end": y} for x, y in spans]))
                yield pd.DataFrame(rows, columns=["key", "item_id", "spans"])

        parts.append(common.write_cut(src.mapInPandas(run, schema)))
        shared.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key").agg(F.min("item_id").alias("item_id"), F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """(doc_id, contaminated, item_id, n_spans) per row; item_id is the smallest verified item, else null."""
    hits = flagged(docs, benchmark, id_col, text_col, **names)
    rows = docs.select(F.col(id_col).alias("doc_id"), common.row_key(F.col(id_col), common.text_key(text_col)).alias("key"))
    return rows.join(hits, "key", "left").select("doc_id", F.col("spans").isNotNull().alias("contaminated"), "item_id",
                                                 F.coalesce(F.array_size("spans"), F.lit(0)).alias("n_spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the contaminated rows; all columns are kept."""
    key = common.fresh(docs, "row_key")
    hits = flagged(docs, benchmark, id_col, text_col, **names).select(F.col("key").alias(key))
    out = docs.withColumn(key, common.row_key(F.col(id_col), common.text_key(text_col)))
    return out.join(hits, key, "left_anti").drop(key)
