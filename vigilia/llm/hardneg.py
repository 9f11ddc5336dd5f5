"""Hard-negative mining by slot-decomposed selection.

Every anchor has ``positives`` rows of its own label with the highest integer inner products. A positive of score p asks for
the best rows of another label in the window lower x p <= 100 x score <= upper x p, and the windows of one anchor overlap.
The positives' upper limits cut the scores into disjoint slots (slot j: above limit j + 1, up to limit j), so each pair of
rows is looked at once, whatever the number of windows. Each task keeps the first k rows of a slot (its combiner), a rank per
(anchor, slot) merges the tasks' rows, and the window of limit j is read off the slots from j on, joined in descending order:
the first k of such a suffix are the best rows up to the limit, and those under the lower bound go last.

Anchors are a stated set of queries against all rows, in blocks of at most ``BLOCK`` numbers: a block is broadcast, and its
two passes (positives, then slots) read the table's three columns without moving a row. A task multiplies tiles of rows by
the block in doubles, which are exact up to 2^53, and in 64-bit integers beyond. What leaves a task is at most
(positives + slots x k) rows an anchor, however many rows share a label or a vector.

Cases: rows with a null id, a null label, a null or empty vector, null or non-finite components, or a squared norm of 2^60 or
more (scores might not fit 64 bits) take no part; only vectors of the anchor's length are its candidates; rows that share
the anchor's id are no positives; repeated anchors (same id, label and vector) count once, other rows that repeat are ranked
each; ties go to the smaller id; fewer rows than asked give fewer; an anchor without positives, a negative positive score
(its window is empty) and empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilia.llm import common
from vigilia.llm import vectors as V

SCALE = 256
BLOCK = 1 << 19  # vector components of a block of anchors: 4 MiB
CELLS = 1 << 20  # scores of a tile
POSITIVES, NEGATIVES, LOWER, UPPER = 5, 5, 80, 100
FOUND = "anchor int, slot int, vec_id long, score long"
ORDER = "vec_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def labelled_vectors(table: DataFrame, label: Column | str = "label", scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the rows that take part."""
    x = F.col("x")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                        V.doubles(F.col(vec_col)).alias("x")).filter("vec_id is not null and label is not null and size(x) > 0").filter(V.finite(x))
    rows = rows.filter(V.squared_norm(F.transform(x, lambda e: e * F.lit(float(scale)))) < V.TOP)
    return rows.select("vec_id", "label", V.floored(x, scale).alias("v"))


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(starts, np.arange(len(g)), 0))
    return order[place < k]


class Best:
    """The first k (score, id) of each group, fed tile by tile."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.held = tuple(np.zeros(0, np.int64) for _ in range(3))  # group, score, id: in order of the groups
        self.least = np.full(groups, np.iinfo(np.int64).min)  # a row below this score is not among the first k
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        live = score >= self.least[group]
        self.new.append((group[live], score[live], ids[live]))
        self.waiting += len(self.new[-1][0])
        if self.waiting > max(CELLS // 16, len(self.held[0])):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, score, ids = (np.concatenate(part) for part in zip(self.held, *self.new, strict=True))
        keep = first_of(group, score, ids, self.k)
        self.held, self.new, self.waiting = (group[keep], score[keep], ids[keep]), [], 0
        full = np.nonzero(np.bincount(self.held[0], minlength=len(self.least)) >= self.k)[0]
        self.least[full] = self.held[1][np.searchsorted(self.held[0], full, side="right") - 1]
        return self.held


class Anchors:
    """One block of anchors: by vector length, their places in the block, labels and vectors."""

    def __init__(self, rows: list):
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        size = np.array([len(r["v"]) for r in rows])
        self.at = {int(d): np.nonzero(size == d)[0] for d in np.unique(size)}
        self.v = {d: np.array([rows[i]["v"] for i in at], np.int64) for d, at in self.at.items()}
        self.norm = {d: float((v.astype(float) ** 2).sum(1).max()) for d, v in self.v.items()}

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places of the anchors, ids, labels, scores: rows x anchors) of tiles of at most about CELLS scores."""
        ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
        for rows, x in V.matrices(batch.column("v")):
            if (a := self.v.get(x.shape[1])) is None:
                continue
            kind = np.float64 if self.norm[x.shape[1]] * float((x.astype(float) ** 2).sum(1).max()) < 2.0**104 else np.int64
            a, step = a.T.astype(kind), max(16, CELLS // len(a))
            for i in range(0, len(rows), step):
                yield self.at[x.shape[1]], ids[rows[i:i + step]], labels[rows[i:i + step]], (x[i:i + step].astype(kind) @ a).astype(np.int64)


def _rows(best: Best, slots: int) -> pa.RecordBatch:
    group, score, ids = best.settle()
    return pa.record_batch({"anchor": pa.array(group // slots, pa.int32()), "slot": pa.array(group % slots, pa.int32()), "vec_id": ids, "score": score})


def _positives(rows: DataFrame, block, k: int) -> DataFrame:
    """First rows of the anchors' own labels, by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = block.value
        best = Best(len(anchors.ids), k)
        for b in batches:
            for at, ids, labels, score in anchors.tiles(b):
                r, c = np.nonzero((labels[:, None] == anchors.labels[at]) & (ids[:, None] != anchors.ids[at]) & (score >= best.least[at]))
                best.add(at[c], score[r, c], ids[r])
        yield _rows(best, 1)

    return rows.mapInArrow(run, FOUND)


def slot_limits(positives: list[list[int]], lower: int, upper: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper limits of the slots of each anchor (descending, filled up with the smallest integer) and the least wanted score."""
    none = np.iinfo(np.int64).min
    width = max([len(set(p)) for p in positives], default=0) or 1
    limits, least = np.full((len(positives), width), none), np.full(len(positives), np.iinfo(np.int64).max)
    for i, p in enumerate(positives):
        bounds = sorted({upper * s // 100 for s in p}, reverse=True)
        limits[i, :len(bounds)] = bounds
        least[i] = min([-(-lower * s // 100) for s in p], default=least[i])
    return limits, least


def _slots(rows: DataFrame, block, k: int) -> DataFrame:
    """First rows of other labels in each slot, by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, limits, least = block.value
        slots = limits.shape[1]
        best = Best(len(anchors.ids) * slots, k)
        for b in batches:
            for at, ids, labels, score in anchors.tiles(b):
                r, c = np.nonzero((score <= limits[at, 0]) & (score >= least[at]) & (labels[:, None] != anchors.labels[at]))
                a, s = at[c], score[r, c]
                best.add(a * slots + (limits[a] >= s[:, None]).sum(1) - 1, s, ids[r])
        yield _rows(best, slots)

    return rows.mapInArrow(run, FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def suffix_windows(slots: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The windows of ``wanted`` (anchor, slot, low, ...) from the slots' rows (anchor, slot, rank, vec_id, score): per window
    the rows of its slot and all later ones in descending order, the first k, then those not under ``low``."""
    held = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "vec_id", "score"))).alias("held"))  # at most slots x k entries
    pairs = wanted.join(held, "anchor")
    suffix = F.slice(F.filter("held", lambda e: e["slot"] >= F.col("slot")), 1, k)
    best = F.filter(suffix, lambda e: e["score"] >= F.col("low"))
    return pairs.select(*wanted.columns, F.posexplode(best).alias("place", "best")).select(*wanted.columns, (F.col("place") + 1).alias("rank"), "best.vec_id", "best.score")


def hard_negatives(table: DataFrame, anchor: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER,
                   upper: int = UPPER, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", block_cells: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    ``lower`` and ``upper`` bound a negative's score as percentages of the positive's."""
    spark = table.sparkSession
    rows = labelled_vectors(table, label, scale, id_col, vec_col)
    asked = common.write_cut(labelled_vectors(table.filter(anchor), label, scale, id_col, vec_col).distinct())
    cells = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-cells // block_cells)
    parts = []
    for i in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()  # block_cells numbers, about
        if held:
            parts.append(_block(rows, Anchors(held), positives, negatives, lower, upper))
    if not parts:
        return spark.createDataFrame([], ORDER.replace("vec_id", "anchor_id", 1))
    return functools.reduce(DataFrame.unionByName, parts)


def _block(rows: DataFrame, anchors: Anchors, positives: int, negatives: int, lower: int, upper: int) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(anchors)
    of: list[list[tuple[int, int]]] = [[] for _ in anchors.ids]
    for r in _merged(_positives(rows, shared, positives), positives).collect():  # ``positives`` rows an anchor
        of[r["anchor"]].append((r["score"], r["vec_id"]))
    limits, least = slot_limits([[s for s, _ in p] for p in of], lower, upper)
    slots = common.write_cut(_merged(_slots(rows, spark.sparkContext.broadcast((anchors, limits, least)), negatives), negatives))
    wanted = [(a, int((limits[a] >= upper * s // 100).sum()) - 1, -(-lower * s // 100), int(anchors.ids[a]), i, s) for a, p in enumerate(of) for s, i in p]
    windows = spark.createDataFrame(wanted, "anchor int, slot int, low long, anchor_id long, positive_id long, positive_score long")
    out = suffix_windows(slots, windows, negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
