"""SimHash near-duplicates over a Golay-code index.

Two 64-bit fingerprints link if they differ in at most ``max_bits`` (0, 1 or 2) bits. A fingerprint is cut into
segments of 23, 23 and 18 bits. The binary Golay code (23, 12) is perfect: every 23-bit word decodes to exactly one
codeword within three bits. The *fuzzy keys* of a word are the codeword indices that the word and its 23 one-bit
neighbours decode to (one to six keys). Two words at most two bits apart share a fuzzy key: the word between them is
a one-bit neighbour (or equal) of both, so both hold the codeword it decodes to. By the pigeonhole principle two
errors leave one of three segments without error, so every link shares one of

    (segment 1 exact, fuzzy key of segment 2), (segment 2 exact, fuzzy key of segment 1),
    (segment 3 exact, fuzzy key of segment 1)

and candidates that share a key are verified by their bit distance. Equal fingerprints are collapsed before the index
is built, so thousands of exact copies cost one entry. A key held by more than ``hot`` fingerprints is not paired:
its members are instead joined on their 65 one-bit neighbourhood words (two fingerprints at most two bits apart share
one), which is exact and linear in the members.

Cases: null text counts as empty, fingerprint zero, linked like any other; a null id stays null and is passed over
when the smallest id of a component is taken; repeated rows are kept; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm import common
from vigilia.llm.components import connected_components

SEED = 42
GOLAY_POLY = 0b101011100011  # generator polynomial of the (23, 12) code
HOT = 512  # fingerprints a key may hold before its members take the one-bit-neighbourhood join
CHUNK = 1 << 15  # shingles turned into bits at a time


def fingerprint(text: str, shingle: int = 3) -> int:
    words = common.lower_words(text)
    if not words:
        return 0
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(buf, SEED)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(first), CHUNK):
        h = np.array([digest(buf[a:b], SEED) for a, b in zip(first[i:i + CHUNK], last[i:i + CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(first), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp): fp holds the unsigned fingerprint's bits in a long."""
    src = common.id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "fp": fps})

    return src.mapInPandas(run, f"doc_id {id_type}, text_key long, fp long")


class Golay:
    """Decoder of the (23, 12) Golay code; its tables are built from the generator polynomial."""

    def __init__(self) -> None:
        def remainder(word: int) -> int:
            for bit in range(22, 10, -1):
                if word >> bit & 1:
                    word ^= GOLAY_POLY << (bit - 11)
            return word

        self.high = np.array([remainder(m << 11) for m in range(1 << 12)], np.int64)  # remainder of the 12 upper bits
        self.error = np.zeros(1 << 11, np.int64)  # syndrome -> error pattern of at most three bits
        one = [1 << i for i in range(23)]
        for i in range(23):
            for j in range(i, 23):
                for k in range(j, 23):
                    e = one[i] | one[j] | one[k]
                    self.error[self.high[e >> 11] ^ (e & 0x7FF)] = e

    def index(self, words: np.ndarray) -> np.ndarray:
        """Index (upper 12 bits) of the codeword nearest to each 23-bit word."""
        syndrome = self.high[words >> 11] ^ (words & 0x7FF)
        return (words ^ self.error[syndrome]) >> 11

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) pairs: the distinct indices of each word and of its one-bit neighbours."""
        near = np.concatenate([words[:, None], words[:, None] ^ (np.int64(1) << np.arange(23, dtype=np.int64))], axis=1)
        idx = np.sort(self.index(near), axis=1)
        fresh = np.concatenate([np.ones((len(words), 1), bool), idx[:, 1:] != idx[:, :-1]], axis=1)
        return np.nonzero(fresh)[0], idx[fresh]


def golay_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) index entries of distinct fingerprints ``fps`` (column fp)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Golay()
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            u = fp.view(np.uint64)
            s1, s2 = (u & np.uint64(0x7FFFFF)).astype(np.int64), (u >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
            s3 = (u >> np.uint64(46)).astype(np.int64)
            (r1, k1), (r2, k2) = code.keys(s1), code.keys(s2)
            for kind, exact, row, key in ((0, s1, r2, k2), (1, s2, r1, k1), (2, s3, r1, k1)):
                yield pd.DataFrame({"key": np.int64(kind) << 40 | exact[row] << 12 | key, "fp": fp[row]})

    return fps.select("fp").mapInPandas(run, "key long, fp long")


def _pairs(groups: DataFrame, max_bits: int) -> DataFrame:
    """Verified pairs (a, b), a < b, inside bounded arrays ``fps``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [np.empty((0, 2), np.int64)]
            for fps in batch["fps"]:
                v = np.unique(np.asarray(fps, np.int64))
                near = np.bitwise_count(v[:, None].view(np.uint64) ^ v[None, :].view(np.uint64)) <= max_bits
                a, b = np.nonzero(np.triu(near, 1))
                out.append(np.stack([v[a], v[b]], axis=1))
            both = np.unique(np.concatenate(out), axis=0)
            yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return groups.select("fps").mapInPandas(run, "a long, b long")


def links(fps: DataFrame, max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints that differ in at most ``max_bits`` bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the Golay index covers 0, 1 or 2 differing bits")
    keys = common.write_cut(golay_keys(fps))
    held = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keys.join(held, "key")
    cold = shared.filter(F.col("n") <= hot).groupBy("key").agg(F.collect_list("fp").alias("fps"))  # at most ``hot`` each
    crowded = shared.filter(F.col("n") > hot).select("fp").distinct()
    flips = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)]))
    balls = crowded.select("fp", flips.alias("z")).groupBy("z").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # at most 65 each
    return _pairs(cold.select("fps").unionByName(balls.select("fps")), max_bits).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, fp, component_id) per row; component_id is the smallest id reachable over links."""
    rows = common.write_cut(fingerprints(docs, id_col, text_col, shingle))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(fps, max_bits, hot))  # only fingerprints that have a link
    comp = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    comp = common.write_cut(comp)
    least = comp.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(comp.join(least, "root").select("fp", "component_id"), "fp")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each component left: that with the smallest id (null ids last), and of rows
    that repeat this id the one whose text hash is smallest. All columns are kept."""
    rows = common.write_cut(fingerprints(docs, id_col, text_col, shingle))
    fps = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"))
    roots = connected_components(links(fps, max_bits))
    comp = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    key = common.fresh(docs, "row_key")
    kept = comp.groupBy("root").agg(F.min("first").alias("first")).select(
        common.row_key(F.col("first.doc_id"), F.col("first.text_key")).alias(key))
    out = docs.withColumn(key, common.row_key(F.col(id_col), common.text_key(text_col)))
    return out.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
