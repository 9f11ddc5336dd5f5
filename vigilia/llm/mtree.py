"""Exact top-k search by inner product with M-trees.

Vectors are integers, floor(1024 x) per component. With M the largest norm, the extra component sqrt(M^2 - |x|^2) puts
all vectors on one sphere, and a query gets 0 there: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products
are the smallest Euclidean distances, a metric that an M-tree can index. Scores and ranks are exact integers; the
distances, in doubles, only prune, with a slack beyond their rounding.

Only the k + 1 smallest ids of equal vectors can be in any result (the query's own row is no candidate), so equal
vectors are cut to those first, by a rank that Spark limits before the shuffle. Then rows are dealt to *pivots* (one
vector in ``shard_rows``, by hash) by least distance, a pivot with more rows than ``shard_rows`` is split by the hash
of the id, and each part is one M-tree, stored as arrays of pages: routing objects with covering radii and distances
to their parent. A query first searches the tree of the nearest pivot; its k-th score then bounds which other trees it
visits (distance to the pivot less the tree's radius). In a tree the search is best-first; stored parent distances rule
out children and entries by the triangle inequality before any distance is computed.

The driver holds the pivots and one (pivot, count, radius) row per tree: n / shard_rows rows.

Cases: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part; only
vectors of the query's length are its candidates; candidate rows that repeat are ranked each, rows that share the
query's id are no candidates; ties go to the smaller id; fewer than k candidates give fewer rows; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilia.llm import common

SCALE = 1024
SHARD_ROWS = (512, 20_000)  # a tree holds about 4 sqrt(n) rows, between these
SALT = 16
PAGE = 128  # entries of a leaf page
FANOUT = 16
DEEP = 24  # levels split by far-apart routing objects; below them by rings of equal size
QUERY_BLOCK = 512
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0").filter(fine)
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column]) if len(column) else np.zeros((0, 0), np.int64)


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Rows on the sphere of squared radius ``top``."""
    f = v.astype(np.float64)
    return np.concatenate([f, np.sqrt(np.maximum(0, top - (f * f).sum(1)))[:, None]], axis=1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distance of every row of x to every row of c."""
    sq = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T
    return np.sqrt(np.maximum(0, sq))


class Tree:
    """An M-tree over vectors ``v`` with ids ``ids``: arrays of nodes and of leaf entries in page order."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, top: float):
        order = np.lexsort((ids, *v.T[::-1]))
        self.ids, self.v, self.top = ids[order], v[order], top
        self.x = lifted(self.v, top)
        self.nodes: list[tuple] = []  # (centre, radius, distance to the parent, first, last, children)
        self.rows: list[np.ndarray] = []
        self.entry: list[np.ndarray] = []
        self.filled = 0
        self._grow(np.arange(len(ids)), 0, None, 0)
        rows = np.concatenate(self.rows) if self.rows else np.zeros(0, np.int64)
        self.entry_distance = np.concatenate(self.entry) if self.entry else np.zeros(0)
        self.ids, self.v, self.x = self.ids[rows], self.v[rows], self.x[rows]

    def _grow(self, members: np.ndarray, centre: int, parent: int | None, depth: int) -> int:
        here = len(self.nodes)
        d = np.sqrt(((self.x[members] - self.x[centre]) ** 2).sum(1))
        up = 0.0 if parent is None else float(np.sqrt(((self.x[centre] - self.x[parent]) ** 2).sum()))
        self.nodes.append((self.x[centre], float(d.max(initial=0)), up, 0, 0, []))
        if len(members) <= PAGE or not d.any():  # a page, or equal vectors (at most k + 1 of them)
            self.rows.append(members)
            self.entry.append(d)
            self.nodes[here] = (*self.nodes[here][:3], self.filled, self.filled + len(members), [])
            self.filled += len(members)
            return here
        seeds, nearest = self._split(members, d) if depth < DEEP else self._rings(members, d)
        for i, s in enumerate(seeds):
            if (part := members[nearest == i]).size:
                self.nodes[here][5].append(self._grow(part, s, centre, depth + 1))
        return here

    def _split(self, members: np.ndarray, d: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Routing objects far from each other, and the nearest one of each member."""
        seeds = [int(members[np.argmax(d)])]
        near = np.sqrt(((self.x[members] - self.x[seeds[0]]) ** 2).sum(1))
        nearest = np.zeros(len(members), np.int64)
        while len(seeds) < min(FANOUT, -(-len(members) // PAGE) + 1) and near.max() > 0:
            seeds.append(int(members[np.argmax(near)]))
            new = np.sqrt(((self.x[members] - self.x[seeds[-1]]) ** 2).sum(1))
            nearest[new < near] = len(seeds) - 1
            near = np.minimum(near, new)
        return seeds, nearest

    def _rings(self, members: np.ndarray, d: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Equal parts by distance from the centre, where far-apart objects kept leaving most members together."""
        place = np.empty(len(members), np.int64)
        place[np.argsort(d, kind="stable")] = np.arange(len(members))
        nearest = place * FANOUT // len(members)
        return [int(members[nearest == i][0]) if (nearest == i).any() else 0 for i in range(FANOUT)], nearest

    def dump(self) -> bytes:
        kids = [n[5] for n in self.nodes]
        out = io.BytesIO()
        np.savez(out, ids=self.ids, v=self.v, x=self.x, entry=self.entry_distance, centre=np.array([n[0] for n in self.nodes]), radius=np.array([n[1] for n in self.nodes]),
                 up=np.array([n[2] for n in self.nodes]), span=np.array([n[3:5] for n in self.nodes], np.int64), top=np.float64(self.top),
                 kids=np.array([c for k in kids for c in k], np.int64), first=np.cumsum([0, *map(len, kids)]))
        return out.getvalue()


class Search:
    """Best-first search in a stored tree."""

    def __init__(self, blob: bytes):
        with np.load(io.BytesIO(blob)) as z:
            self.__dict__ |= {k: z[k] for k in z.files}
        self.kids = [self.kids[a:b] for a, b in zip(self.first[:-1], self.first[1:], strict=True)]
        self.computed = 0

    def query(self, own: int, q: np.ndarray, k: int, bound: int | None) -> list[tuple[int, int]]:
        """The k best (score, vec_id) that can be in the result; ``bound`` is a score that k rows elsewhere reach."""
        f = np.append(q.astype(np.float64), 0.0)
        sphere = float((f * f).sum() + self.top)
        slack = 1e-9 * sphere + 1

        def limit(score: int) -> float:
            return float(np.sqrt(max(0.0, sphere - 2.0 * score + slack)))

        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        tau = np.inf if bound is None else limit(bound)
        d0 = float(np.sqrt(((self.centre[0] - f) ** 2).sum()))
        heap = [(max(0.0, d0 - self.radius[0]), 0, d0)]
        while heap:
            least, node, d = heapq.heappop(heap)
            if least > tau:
                break
            if len(self.kids[node]):
                c = self.kids[node]
                c = c[np.abs(d - self.up[c]) - self.radius[c] <= tau]  # no distance needed for the others
                if len(c):
                    self.computed += len(c)
                    dc = np.sqrt(((self.centre[c] - f) ** 2).sum(1))
                    low = np.maximum(least, dc - self.radius[c])
                    for i in np.nonzero(low <= tau)[0]:
                        heapq.heappush(heap, (float(low[i]), int(c[i]), float(dc[i])))
                continue
            a, b = self.span[node]
            rows = a + np.nonzero(np.abs(d - self.entry[a:b]) <= tau)[0]
            if not len(rows):
                continue
            self.computed += len(rows)
            score, ids = self.v[rows] @ q, self.ids[rows]
            if len(best) == k:
                keep = score >= best[0][0]
                score, ids = score[keep], ids[keep]
            for s, i in zip(score.tolist(), ids.tolist(), strict=True):
                if i != own:
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                tau = min(tau, limit(best[0][0]))
        return [(s, -i) for s, i in best]


class Pivots:
    """Routing objects over all trees of one vector length."""

    def __init__(self, v: np.ndarray, top: float):
        self.v, self.top, self.x = v, top, lifted(v, top)

    def nearest(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[_distances(lifted(v[i:i + 4096], self.top), self.x).argmin(1) for i in range(0, len(v), 4096)]])


def _assign(vectors: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dim = b["v"].map(len)
            for d, part in b.groupby(dim):
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "dim": np.int32(d), "pivot": pivots[d].nearest(_matrix(part["v"])).astype(np.int32)})

    return vectors.mapInPandas(run, "vec_id long, v array<long>, dim int, pivot int")


def _build(rows: DataFrame, tops: dict[int, float]) -> DataFrame:
    """(dim, pivot, part, tree, radius): one tree per part; groups are bounded by shard_rows (about)."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        d, p, s = (int(part[c].iloc[0]) for c in ("dim", "pivot", "part"))
        tree = Tree(part["vec_id"].to_numpy(np.int64), _matrix(part["v"]), tops[d])
        return pd.DataFrame({"dim": [d], "pivot": [p], "part": [s], "radius": [tree.nodes[0][1]], "centre": [tree.nodes[0][0].tolist()], "tree": [tree.dump()]})

    return rows.groupBy("dim", "pivot", "part").applyInPandas(build, "dim int, pivot int, part int, radius double, centre array<double>, tree binary")


def _search(trees: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (dim, pivot, part, block, query_id, v, bound) against the named trees; queries come in bounded blocks."""
    blocks = wanted.groupBy("dim", "pivot", "part", "block").agg(F.collect_list(F.struct("query_id", "v", "bound")).alias("queries"))
    pairs = blocks.join(trees.select("dim", "pivot", "part", "tree"), ["dim", "pivot", "part"]).select("queries", "tree")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for queries, blob in zip(b["queries"], b["tree"], strict=True):
                tree = Search(blob)
                out = [(r["query_id"], i, s) for r in queries
                       for s, i in tree.query(r["query_id"], np.asarray(r["v"], np.int64), k, None if r["bound"] is None or pd.isna(r["bound"]) else int(r["bound"]))]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return pairs.mapInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``table`` with the largest inner product for every row of ``queries``."""
    spark = table.sparkSession
    vectors = integer_vectors(table, id_col, vec_col)
    # the first ids of equal vectors, first per salted part: a vector that a third of the rows share is many small windows
    for part in ([F.col("v"), F.pmod(F.xxhash64("vec_id"), F.lit(SALT))], [F.col("v")]):
        vectors = vectors.withColumn("rn", F.row_number().over(Window.partitionBy(*part).orderBy("vec_id"))).filter(F.col("rn") <= k + 1).drop("rn")
    vectors = common.write_cut(vectors)
    square = F.aggregate(F.col("v"), F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    sizes = {r["dim"]: r for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("top")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tops = {d: float(r["top"]) for d, r in sizes.items()}
    least, most = SHARD_ROWS
    shard_rows = shard_rows or min(most, max(least, int(4 * max(r["n"] for r in sizes.values()) ** 0.5)))
    pivots = {}
    for d, r in sizes.items():
        n = -(-r["n"] // shard_rows)
        pick = vectors.filter(F.size("v") == d).orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id", "v").limit(n)
        pivots[d] = Pivots(_matrix([x["v"] for x in pick.select("v").collect()]), tops[d])
    rows = common.write_cut(_assign(vectors, pivots))
    held = rows.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))  # one row per pivot
    rows = rows.join(held, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), "parts").cast("int"))
    trees = common.write_cut(_build(rows, tops))
    meta = [(r["dim"], r["pivot"], r["part"], r["radius"], r["centre"]) for r in trees.drop("tree").collect()]
    shape = {d: [(p, s, rad, c) for x, p, s, rad, c in meta if x == d] for d in sizes}

    asked = integer_vectors(queries, id_col, vec_col).withColumnRenamed("vec_id", "query_id").distinct()

    def home(first: bool):
        """Trees that a query visits: the one with the least bound first, then all others that its bound allows."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = {d: (np.array([c for *_, c in t]), np.array([rad for _, _, rad, _ in t]), np.array([(p, s) for p, s, _, _ in t], np.int64)) for d, t in shape.items() if t}
            for b in batches:
                out = []
                bounds = b["bound"] if "bound" in b else [None] * len(b)
                for q, v, bound in zip(b["query_id"], b["v"], bounds, strict=True):
                    if len(v) not in known:
                        continue
                    centre, radius, names = known[len(v)]
                    f = np.append(np.asarray(v, np.float64), 0.0)
                    d = np.sqrt(((centre - f) ** 2).sum(1))
                    start = int(np.argmin(d))
                    if first:
                        pick = [start]
                    else:
                        sphere = float((f * f).sum() + tops[len(v)])
                        tau = np.inf if bound is None or pd.isna(bound) else np.sqrt(max(0.0, sphere - 2.0 * float(bound) + 1e-9 * sphere + 1))
                        pick = [i for i in np.nonzero(d - radius <= tau)[0] if i != start]
                    out += [(len(v), *names[i].tolist(), q, v, bound) for i in pick]
                yield pd.DataFrame(out, columns=["dim", "pivot", "part", "query_id", "v", "bound"]).astype({"bound": "Int64"})

        return run

    schema = "dim int, pivot int, part int, query_id long, v array<long>, bound long"
    block = _query_blocks
    near = common.write_cut(_search(trees, block(asked.mapInPandas(home(True), schema)), k))
    kth = _best(near, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    others = asked.join(kth, "query_id", "left").mapInPandas(home(False), schema)
    far = _search(trees, block(others), k)
    return _best(near.unionByName(far), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _query_blocks(wanted: DataFrame) -> DataFrame:
    """Split the queries of each tree into blocks of about QUERY_BLOCK by the hash of the id."""
    wanted = common.write_cut(wanted)
    load = wanted.groupBy("dim", "pivot", "part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    return wanted.join(load, ["dim", "pivot", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("block")), "blocks").cast("int"))


def divisible(col: Column | str, by: int) -> Column:
    return F.pmod(F.col(col) if isinstance(col, str) else col, F.lit(by)) == 0
