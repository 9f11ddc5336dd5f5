"""Language-model scores by online logistic context mixing, and a unigram base score.

The text is a sequence of words (A-Z in lower case, split on ASCII white space), each followed by a space, and an end
mark. Bytes are coded as the binary decisions of a code tree built from the corpus's byte counts (frequent bytes take
few decisions). For every decision several predictors, one per hashed context (``ORDERS``: the last 1, 2 and 4 bytes
and the word so far), look up how often this decision went either way in that context in the training documents. The
logits of their estimates are combined by weights that a gate (how many contexts were seen) selects. The weights are
learned online: they follow the logistic loss's gradient block by block through the document, and an adaptive
probability map (gate x quantised logit) refines the mixed probability likewise. A document's state starts anew from
weights and a map learned on all training documents, so its score depends on what was trained and its own text alone.
The score is the base-10 logarithm of the text's probability; its negative, in binary, is the total number of bits, and
per byte the bits per byte.

Training reads every training document: each task sums equal bytes in equal contexts (by sorting) and counts their
decisions, each with its number, in dense arrays of ``1 << BITS`` slots per context (bounded, however much it reads); the
shuffle brings the 4096-slot pages of all tasks together, and pages of quantised logits come back: a table of ``len(ORDERS) << BITS`` bytes, whatever the corpus's size, is broadcast. The counts are
kept in two folds (by the text's hash, so equal texts share one), and the starting weights and map are learned from
every training document by the table of the other fold, which has not counted it: one pass counts all decisions by the
bins of their contexts' logits (``BINS`` a context), and from these counts the driver takes ``ROUNDS`` Newton steps from
``START`` and then the share of either way in each cell of the map.

Word counts for the base score are summed over all training documents. The ``HEAD`` most frequent words are broadcast;
all other words of a document are joined with the counts by a shuffle.

Cases: null and empty texts are the end mark alone; a null id is a training row; an empty training set has N = V = 0
and tables without counts; repeated rows count and score each; very long texts are scored whole, in blocks; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm import common
from vigilia.llm.quality import remainder

ORDERS = (1, 2, 4, "word")
BITS = 20
PAGE = 4096
HEAD = 1 << 17
START = (0.1, 0.2, 0.4, 0.5)  # weights before anything is learned
ROUNDS = 6  # Newton steps on the training documents
BINS = 17  # of quantised logits, when decisions are counted for those steps; one for slots never seen
BLOCKS = (256, 2048)  # decisions of a document's first block, and of the longest; each block is twice the one before
RATE = 0.02
APM_RATE = 0.1
STEP = 12.0  # quantised logits: 1 / 12 per unit, 0 for a slot that was never seen
CHUNK = 1 << 18  # bytes turned into decisions at a time (arrays stay in the cache)
GROUP = 512  # documents of a group, at most
MIXED = 1 << 17  # decisions mixed at a time
RUN = 1 << 22  # bytes whose contexts are sorted and summed at a time
TALLY = 300_000
END = 10  # the end mark: no word holds it
GATES = len(ORDERS) + 1
CELLS = 33  # quantised logits of the map, per gate
TOP = np.float32(7.99)  # bound of mixed logits: no decision costs more than about 13 bits
_RATES = ((1 - (1 - APM_RATE) ** np.arange(9)) * 0.5).astype(np.float32)  # of the map, by hits in a block
_IDENTITY = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, CELLS))), GATES).astype(np.float32)  # the map before anything is learned
_FIRM = 64  # decisions that the identity counts for in each cell of the learned map
_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_PLACE = np.array([(i + 1) * 0xD6E8FEB86659FD93 % (1 << 64) | 1 for i in range(64)], _U)  # by place in the word


def encoded(text: str) -> bytes:
    words = common.lower_words(text)
    return b" ".join([*words, bytes([END])])


class Code:
    """Binary code tree over bytes: ``nodes`` and ``ways`` hold the decisions of each byte, one after another."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        serial = 256
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (serial, 0), (serial, 1)
            heapq.heappush(heap, (a + b, serial, serial))
            serial += 1
        paths = []
        for s in range(256):
            path, at = [], s
            while at in parent:
                at, way = parent[at]
                path.append((at - 256, way))
            paths.append(path[::-1])
        self.size = np.array([len(p) for p in paths], np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int32)
        self.ways = np.array([w for p in paths for _, w in p], np.uint8)
        nodes = np.array([n for p in paths for n, _ in p], np.uint64)
        self.salt = ((nodes + _U(1)) * _K >> _U(64 - BITS)).astype(np.uint32)  # node's part of a slot

    def decisions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of its byte, node's part of its slot, its way) of every decision."""
        n = self.size[data]
        begins = np.cumsum(n, dtype=np.int64)
        total = int(begins[-1]) if len(begins) else 0
        begins -= n
        of = np.zeros(total, np.int64)
        of[begins[1:]] = 1  # every byte takes a decision at least
        np.cumsum(of, out=of)
        at = (self.first[data] - begins).take(of)
        at += np.arange(total)
        return of, self.salt.take(at), self.ways.take(at)


def past(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the four bytes before, the nearest one lowest; number of the word so far) at every byte; ``begins`` are the places
    where documents begin."""
    d = data.astype(np.uint32)
    last = np.zeros(len(d), np.uint32)
    for k in range(1, 5):
        last[k:] |= d[: max(0, len(d) - k)] << np.uint32(8 * (k - 1))
    for k in range(4):  # nothing from before the document
        at = begins + k
        last[at[at < len(d)]] &= np.uint32((1 << 8 * k) - 1)
    # the bytes since the last space, each by its place in the word: a difference of running sums
    place = np.arange(len(d), dtype=np.int32)
    word = np.zeros(len(d), np.int32)
    word[begins] = begins
    space = np.nonzero(data[:-1] == 32)[0] + 1
    word[space] = space
    word = np.maximum.accumulate(word)
    step = place - word
    total = np.zeros(len(d) + 1, _U)
    d += np.uint32(1)
    np.cumsum(_PLACE.take(np.minimum(step, len(_PLACE) - 1)) * d, dtype=_U, out=total[1:])
    return last, total[:-1] - total.take(word) + step.astype(_U)


def _hashed(number: np.ndarray, i: int) -> np.ndarray:
    """BITS-bit hash of the numbers of context ``i``."""
    h = number.astype(_U)
    h += _U(i + 1)
    h *= _K
    h ^= h >> _U(29)
    h *= _K
    h >>= _U(64 - BITS)
    return h.astype(np.uint32)


def contexts(data: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """BITS-bit hash of each context at every byte; ``begins`` are the places where documents begin."""
    last, word = past(data, begins)
    return [_hashed(word if o == "word" else last & np.uint32((1 << 8 * o) - 1), i) for i, o in enumerate(ORDERS)]


def slots(context: np.ndarray, of: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Slot of each decision in a table of 1 << BITS."""
    h = context.take(of)
    h ^= salt
    return h


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Documents in groups of about CHUNK bytes, GROUP documents at most."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK or len(held) >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(docs), np.uint8)
    return data, np.cumsum([0, *map(len, docs[:-1])])


def byte_and_word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all training documents, the end mark included; each task sums before the shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                tally.update(common.lower_words(t))
                tally[b"\n"] += 1
                if len(tally) > TALLY:
                    yield pd.DataFrame({"word": list(tally), "n": list(tally.values())})
                    tally.clear()
        yield pd.DataFrame({"word": pd.Series(list(tally), dtype=object), "n": pd.Series(list(tally.values()), dtype="int64")})

    return train.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def byte_counts(words: DataFrame) -> np.ndarray:
    """Counts of the 256 bytes of the encoded training text, from the word counts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for w, n in zip(b["word"], b["n"], strict=True):
                np.add.at(total, np.frombuffer(w, np.uint8), n)
                total[32] += n if w != b"\n" else 0
        yield pd.DataFrame({"byte": np.arange(256), "n": total})

    out = np.zeros(256, np.int64)
    for r in words.mapInPandas(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def fold_of(text: bytes) -> int:
    return zlib.crc32(text) & 1


def _tallies(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of the bytes of all encoded documents, about RUN bytes at a time. A key holds the fold, the byte, the
    four bytes before (the nearest one highest) and the hash of the word so far, so it tells every context; keys ascend."""
    held, size = [], 0
    for b in batches:
        texts = [encoded(t) for t in b["text"]]
        for fold in (0, 1):
            for docs in pieces([t for t in texts if fold_of(t) == fold]):
                data, begins = _joined(docs)
                last, word = past(data, begins)
                key = data.astype(_U)
                key |= _U(fold << 8)
                key <<= _U(32)
                key |= last.byteswap()
                key <<= _U(BITS)
                key |= _hashed(word, len(ORDERS) - 1)
                held.append(key)
                size += len(key)
                if size >= RUN:
                    yield _summed(held)
                    held, size = [], 0
    if held:
        yield _summed(held)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.concatenate([np.zeros(1, np.int64), np.nonzero(values[1:] != values[:-1])[0] + 1])


def _summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(held)
    held.clear()
    keys.sort()
    first = _firsts(keys)
    return keys[first], np.diff(first, append=len(keys)).astype(np.int32)


def _of_fold(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fold, keys, counts) of _tallies for each fold, CHUNK / 4 keys at a time."""
    middle = int(np.searchsorted(keys, _U(1 << 40 + BITS)))
    for fold, (begin, end) in enumerate(((0, middle), (middle, len(keys)))):
        for i in range(begin, end, CHUNK >> 2):
            j = min(end, i + (CHUNK >> 2))
            yield fold, keys[i:j], n[i:j]


def _byte_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> _U(32 + BITS)).astype(np.uint8)


def _context_of(keys: np.ndarray, i: int) -> np.ndarray:
    """BITS-bit hash of context ``i`` of keys of _tallies."""
    o = ORDERS[i]
    if o == "word":
        return (keys & _U((1 << BITS) - 1)).astype(np.uint32)
    last = (keys >> _U(BITS)).astype(np.uint32).byteswap()
    return _hashed(last & np.uint32((1 << 8 * o) - 1), i)


def train_tables(train: DataFrame, code: Code) -> np.ndarray:
    """Quantised logits of all slots, int8 of 3 x (len(ORDERS) << BITS): learned from every training document, and from
    those of fold 0 and fold 1."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, len(ORDERS), 2 << BITS), np.int32)
        for every, counts in _tallies(batches):
            for fold, keys, n in _of_fold(every, counts):
                for i, o in enumerate(ORDERS):
                    k, c = keys, n
                    if o != "word":  # keys that agree in this context stand together
                        first = _firsts(keys >> _U(BITS + 32 - 8 * o))
                        k, c = keys[first], np.add.reduceat(n, first, dtype=np.int32)
                    of, salt, way = code.decisions(_byte_of(k))
                    at = slots(_context_of(k, i), of, salt)
                    at += at
                    at += way
                    np.add.at(total[fold, i], at, c.take(of))
        by_page = total.reshape(2, -1, 2 * PAGE)
        seen = np.nonzero(by_page.any(axis=(0, 2)))[0]
        for i in range(0, len(seen), 64):
            pages = seen[i:i + 64]
            yield pd.DataFrame({"page": pages.astype(np.int32), "counts": [by_page[:, p].tobytes() for p in pages]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}  # at most (len(ORDERS) << BITS) / PAGE pages
        for b in batches:
            for page, counts in zip(b["page"], b["counts"], strict=True):
                got = np.frombuffer(counts, np.int32)
                if page in sums:
                    sums[page] += got
                else:
                    sums[page] = got.astype(np.int64)
        for page, pairs in sums.items():
            zeros, ones = np.moveaxis(pairs.reshape(2, PAGE, 2), 2, 0).astype(float)
            zeros, ones = np.vstack([zeros.sum(axis=0), zeros]), np.vstack([ones.sum(axis=0), ones])
            logit = np.clip(np.rint(np.log((ones + 0.4) / (zeros + 0.4)) * STEP), -127, 127).astype(np.int8)
            logit[(logit == 0) & (zeros + ones > 0)] = 1  # 0 stands for slots never seen
            yield pd.DataFrame({"page": [page], "logits": [logit.tobytes()]})

    counted = train.select("text").mapInPandas(count, "page int, counts binary")
    pages = counted.repartition("page").mapInPandas(pack, "page int, logits binary")
    tables = np.zeros((3, len(ORDERS) << BITS), np.int8)
    for r in pages.collect():  # at most (len(ORDERS) << BITS) / PAGE rows of 3 PAGE bytes
        tables[:, r["page"] * PAGE:(r["page"] + 1) * PAGE] = np.frombuffer(r["logits"], np.int8).reshape(3, PAGE)
    return tables


def train_table(train: DataFrame, code: Code) -> np.ndarray:
    """Quantised logits of all slots, int8 of len(ORDERS) << BITS, learned from every training document."""
    return train_tables(train, code)[0]


def start_state() -> tuple[np.ndarray, np.ndarray]:
    """(weights, map) before anything is learned: gate x context, and gate x quantised logit."""
    return np.tile(np.array(START, np.float32) / np.float32(STEP), (GATES, 1)), _IDENTITY


def _gate(x: np.ndarray) -> np.ndarray:
    """How many contexts were seen, of each decision; ``x``: int8, contexts x decisions."""
    out = (x[0] != 0).view(np.int8)
    for row in x[1:]:
        out = out + (row != 0)
    return out


def _cell(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Bounds the mixed logits ``z`` in place; cell of the map of each decision."""
    np.minimum(z, TOP, out=z)
    np.maximum(z, -TOP, out=z)
    out = (z * 2 + 16.5).astype(np.int64)
    out += gate * np.int64(CELLS)
    return out


def _bin(x: np.ndarray) -> np.ndarray:
    """Quantised logits in BINS bins; 0 keeps its own."""
    return np.where(x == 0, 0, ((x.astype(np.int16) + 128) >> 4) + 1).astype(np.int32)


def _histogram(train: DataFrame, code: Code, tables) -> np.ndarray:
    """Decisions of all training documents by the bins of their contexts' logits (by the table of the other fold) and their
    way: int64 of BINS ** len(ORDERS) x 2; each task sums its own first."""
    m = len(ORDERS)
    cells = BINS**m * 2
    place = _bin(np.arange(256, dtype=np.uint8).view(np.int8)).astype(np.uint8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells, np.int64)
        halves = place[tables.value.reshape(3, m, -1)[:0:-1].view(np.uint8)]  # the table that has not counted fold 0, and fold 1
        for every, counts in _tallies(batches):
            for fold, keys, n in _of_fold(every, counts):
                of, salt, way = code.decisions(_byte_of(keys))
                at = np.zeros(len(way), np.int32)
                for i in range(m):
                    at *= BINS
                    at += halves[fold][i].take(slots(_context_of(keys, i), of, salt))
                at += at
                at += way
                np.add.at(total, at, n.astype(np.int64).take(of))
        held = np.nonzero(total)[0]
        yield pd.DataFrame({"at": held.astype(np.int32), "n": total[held]})

    out = np.zeros(cells, np.int64)
    got = train.select("text").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # ``cells`` rows at most
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(-1, 2)


def learned_state(train: DataFrame, code: Code, tables) -> tuple[np.ndarray, np.ndarray]:
    """(weights, map) at the start of a document, learned from every training document by the other fold's table.

    ``tables``: broadcast of what train_tables returns."""
    m = len(ORDERS)
    weights, apm = start_state()
    counts = _histogram(train, code, tables)
    held = np.nonzero(counts.sum(axis=1))[0]
    zeros, ones = counts[held].T.astype(float)
    bins = np.stack([held // BINS ** (m - 1 - i) % BINS for i in range(m)])
    x = np.where(bins == 0, 0, bins * 16 - 136).astype(np.float32)  # the middle of each bin
    gate = np.count_nonzero(bins, axis=0)
    for _ in range(ROUNDS):
        for g in range(1, GATES):
            of = gate == g
            xg, n = x[:, of].astype(float), zeros[of] + ones[of]
            p = 1 / (1 + np.exp(-(weights[g] @ xg)))
            step = np.linalg.solve((xg * (n * p * (1 - p))) @ xg.T + np.eye(m) * STEP * STEP, xg @ (ones[of] - n * p))
            weights[g] += np.clip(step, -0.5 / STEP, 0.5 / STEP)
    cell = _cell((weights[gate] * x.T).sum(axis=1), gate)
    hits = [np.bincount(cell, weights=w, minlength=GATES * CELLS) for w in (zeros, ones)]
    return weights, ((hits[1] + _FIRM * apm) / (hits[0] + hits[1] + _FIRM)).astype(np.float32)


def mixed_bits(logits: np.ndarray, way: np.ndarray, sizes: list[int] | np.ndarray | None = None, start: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Bits that each document's decisions cost: gated online mixing, then the adaptive probability map.

    ``logits``: int8, contexts x decisions, document after document; ``sizes``: decisions of each; ``start``: (weights, map)
    before the first block. Block k of all documents is one step; each document has weights and a map of its own."""
    sizes = np.array([len(way)] if sizes is None else sizes, np.int64)
    order = np.argsort(-sizes, kind="stable")  # the documents that have a block k come first
    begins = np.cumsum(sizes) - sizes
    first_weights, first_apm = start or start_state()
    state = first_weights.astype(np.float32), np.concatenate([first_apm.astype(np.float32), _IDENTITY[:CELLS]])
    behind = np.zeros((len(logits) + 1, BLOCKS[1]), np.int8)  # a last block may be read past the end
    logits, way = np.hstack([logits, behind[1:]]), np.concatenate([way, behind[0].view(np.uint8)])
    out, at = np.zeros(len(sizes)), 0
    while at < len(order):
        docs = order[at:at + max(1, MIXED // min(BLOCKS[1], max(1, int(sizes[order[at]]))))]
        out[docs] = _mixed(logits, way, begins[docs], sizes[docs], state)
        at += len(docs)
    return out


def _mixed(logits: np.ndarray, way: np.ndarray, begins: np.ndarray, held: np.ndarray, state: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bits of documents that are mixed side by side, the longest first; ``held``: decisions of each.

    A block is a rectangle of documents x decisions. Places behind a document's end have gate GATES, whose weights and
    map no decision uses. Most decisions have seen every context: these take their document's weights row by row, the
    others one by one."""
    m, top, cells = len(ORDERS), GATES - 1, (GATES + 1) * CELLS
    weights = np.tile(state[0], (len(held), 1, 1))  # document x gate x context
    apm = np.tile(state[1], len(held))
    bits = np.zeros(len(held))
    begin, size = 0, BLOCKS[0]
    while live := int(np.searchsorted(-held, -begin)):
        n = np.minimum(held[:live] - begin, size)
        width, whole = int(n[0]), int(np.searchsorted(-n, -n[0], side="right"))
        rows = begins[:live] + begin
        q = np.lib.stride_tricks.sliding_window_view(logits, width, axis=1)[:, rows]
        y = np.lib.stride_tricks.sliding_window_view(way, width)[rows]
        gate = _gate(q)
        behind = np.arange(width) >= n[whole:, None]
        if whole < live:
            q[:, whole:][:, behind] = 0
            gate[whole:][behind] = GATES
        x = q.astype(np.float32)
        z = weights[:live, top, 0, None] * x[0]
        for i in range(1, m):
            z += weights[:live, top, i, None] * x[i]
        few = np.nonzero(gate.ravel() < top)[0] if gate.min() < top else ()
        if len(few):
            row = few // width * GATES + gate.ravel()[few]
            few_x = x.reshape(m, -1)[:, few]
            few_w = weights.reshape(-1, m)[row]
            few_z = few_w[:, 0] * few_x[0]
            for i in range(1, m):
                few_z += few_w[:, i] * few_x[i]
            z.ravel()[few] = few_z
        every = whole == live and not len(few)  # all decisions have seen every context
        cell = _cell(z, 0 if every else gate)
        cell += np.arange(top * CELLS if every else 0, live * cells, cells)[:, None]
        p = np.exp(-z, out=z)
        p += 1
        np.divide(1, p, out=p)
        told = apm.take(cell)  # of way 1
        told += p
        told *= 0.5
        told += y
        told -= 1
        np.abs(told, out=told)
        np.log2(told, out=told)
        bits[:whole] -= told[:whole].sum(axis=1, dtype=np.float64)
        for i in range(whole, live):  # once for each document; the others' lengths leave its sum as it is
            bits[i] -= told[i, :n[i]].sum(dtype=np.float64)
        err = np.subtract(y, p, out=p)
        err *= (RATE / STEP / STEP / np.maximum(1.0, n / 64)).astype(np.float32)[:, None]
        if len(few):
            few_err = err.ravel()[few]
            err.ravel()[few] = 0
            for i in range(m):
                weights[:live, :, i] += np.bincount(row, weights=few_err * few_x[i], minlength=live * GATES).reshape(live, GATES)
        for i in range(m):
            weights[:live, top, i] += np.multiply(x[i], err, out=x[i]).sum(axis=1, dtype=np.float64)
        cell += cell
        cell += y
        ways = np.bincount(cell.ravel(), minlength=2 * live * cells)
        hits = ways[::2] + ways[1::2]
        seen = np.nonzero(hits)[0]
        hits, ones = hits[seen], ways[1::2][seen]
        apm[seen] += _RATES[np.minimum(hits, 8)] * (ones / hits - apm[seen])
        begin, size = begin + size, min(2 * size, BLOCKS[1])
    return bits


class Scorer:
    def __init__(self, code: Code, table: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None):
        self.code, self.table, self.start = code, table.reshape(len(ORDERS), -1), start

    def bits(self, docs: list[bytes]) -> list[float]:
        """Total bits of each encoded document."""
        order = sorted(range(len(docs)), key=lambda i: len(docs[i]))  # documents of one length step through their blocks together
        out: list[float] = []
        for group in pieces([docs[i] for i in order]):
            data, begins = _joined(group)
            of, salt, way = self.code.decisions(data)
            logits = np.stack([self.table[i].take(slots(c, of, salt)) for i, c in enumerate(contexts(data, begins))])
            out += mixed_bits(logits, way, np.add.reduceat(self.code.size[data], begins), self.start).tolist()
        return [b for _, b in sorted(zip(order, out, strict=True))]


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row."""
    spark = docs.sparkSession
    src = common.id_text(docs, id_col, text_col).withColumn("held_out", remainder("doc_id") == 1)
    train = src.filter(~F.col("held_out"))
    words = common.write_cut(byte_and_word_counts(train))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, floor = int(total["n"]), float(total["n"]) + 0.5 * (total["v"] + 1)
    code = Code(byte_counts(words))
    top = words.filter(F.col("n") >= common.count_threshold(words, head))
    tables = spark.sparkContext.broadcast(train_tables(train, code))
    start = learned_state(train, code, tables)
    shared = spark.sparkContext.broadcast({"table": tables.value[0], "start": start, "head": {bytes(r["word"]): r["n"] for r in top.collect()}})
    id_type = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_key long, held_out boolean, n_tokens long, n_known long, head_score double, score double, n_bytes long, rare array<binary>, tf array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value["head"]
        scorer = Scorer(code, shared.value["table"], shared.value["start"])
        value = {w: float(np.log10((c + 0.5) / floor)) for w, c in held.items()}
        for b in batches:
            rows, data = [], []
            for t in b["text"]:
                tokens = [*common.lower_words(t), b"\n"]
                got = [*map(value.get, tokens)]
                rare = [w for w, v in zip(tokens, got, strict=True) if v is None] if None in got else []
                tf = Counter(rare)
                rows.append((len(tokens), len(tokens) - len(rare), float(sum(v for v in got if v is not None) if rare else sum(got)), [*tf], [*tf.values()]))
                data.append(b" ".join(tokens))
            out = pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "held_out": b["held_out"]}).reset_index(drop=True)
            out["n_tokens"], out["n_known"], out["head_score"] = ([r[i] for r in rows] for i in range(3))
            out["score"] = np.array(scorer.bits(data)) * -np.log10(2)
            out["n_bytes"], out["rare"], out["tf"] = [len(x) for x in data], [r[3] for r in rows], [r[4] for r in rows]
            yield out

    scored = common.write_cut(src.withColumn("text_key", F.xxhash64("text")).mapInPandas(run, schema))
    # rare words (outside the broadcast head) get their counts by a join; equal (id, text) rows have equal sums
    key = common.row_key(F.col("doc_id"), F.col("text_key"))
    spread = scored.select(key.alias("key"), "rare", "tf").filter(F.size("rare") > 0).dropDuplicates(["key"]).select("key", F.explode(F.arrays_zip(F.col("rare").alias("word"), "tf")).alias("w"))
    spread = spread.select("key", "w.word", "w.tf").join(words, "word", "left")
    value = F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.5)) / F.lit(floor or 0.5))
    rare = spread.groupBy("key").agg(F.sum(F.col("tf") * value).alias("rare_score"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    out = scored.drop("rare", "tf").withColumn("key", key).join(rare, "key", "left")
    zero = F.lit(0)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
                      (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), "score",
                      (F.col("score") * -F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))
