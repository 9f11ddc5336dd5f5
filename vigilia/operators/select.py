"""Rows at given ranks by radix selection, without sorting the table.

An exact stratified split needs one row per class and cut: the row whose rank in a seeded order is the cut. The order's first
column is counted per class in ``RANGES`` equal ranges; only the range that holds a wanted rank is looked at again, in
``RANGES`` finer ranges, and so on through the order's columns until at most ``SMALL`` rows are left, which are ranked. Each
step reads the group and order columns only and brings at most groups x ranks x RANGES counts to the driver. A row's place
before or behind such a row is then a comparison in the row itself: the table is neither shuffled nor written.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 4096
SMALL = 1 << 16
GROUPS = 64  # more groups than this are ranked by windows (``prefix``)


class Part(NamedTuple):
    """Rows of one group that share the ranges of ``steps`` (column, lowest value, width, number of the range)."""

    group: Any
    steps: tuple = ()
    column: int = 0

    def holds(self, ranges: int) -> Column:
        out = F.col("_g").eqNullSafe(F.lit(self.group))
        for column, lo, width, number in self.steps:
            out = out & (_range(column, lo, width, ranges) == number)
        return out


def _value(column: int) -> Column:
    return F.col(f"_o{column}").cast("double")


def _range(column: int, lo: float, width: float, ranges: int) -> Column:
    """Number of the value's range; NULL comes first, as in a sort."""
    place = F.floor((_value(column) - F.lit(lo)) / F.lit(width)).cast("int")
    return F.when(place.isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(0), F.least(place, F.lit(ranges - 1))))


def _tagged(rows: DataFrame, tags: list[Column]) -> DataFrame:
    """One row per tag that is not NULL."""
    return rows.select(F.explode(F.array_compact(F.array(*tags))).alias("t")).select("t.*")


def keys_at_ranks(df: DataFrame, by: str, order: Sequence[str], wanted: Callable[[int], Sequence[int]], ranges: int = RANGES,
                  small: int = SMALL) -> tuple[dict, dict] | None:
    """({group: rows}, {group: [order values of the row at each wanted rank]}).

    ``wanted(n)`` gives the 1-based ranks of a group of n rows; a rank of 0 gives None, ranks end at n. NULL is a group like any
    other. Returns None for more than ``GROUPS`` groups. Rows that agree in all of ``order`` share a place, so ``order`` ends
    with a unique column. Columns that are not numeric are not counted in ranges: from there on rows are ranked.
    """
    numeric = [isinstance(df.schema[c].dataType, T.NumericType) for c in order]
    rows = df.select(F.col(by).alias("_g"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]).persist(StorageLevel.DISK_ONLY)
    try:
        found = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).limit(GROUPS + 1).collect()
        if len(found) > GROUPS:
            return None
        sizes = {r["_g"]: r["n"] for r in found}
        ranks = {g: [min(k, n) for k in wanted(n)] for g, n in sizes.items()}
        open_parts: dict[Part, list] = {Part(g): [(g, i, k) for i, k in enumerate(ks) if k > 0] for g, ks in ranks.items()}
        counts = {Part(g): n for g, n in sizes.items()}
        ready: dict[Part, list] = {}
        while open_parts:
            for part in [p for p in open_parts if counts[p] <= small or p.column == len(order) or not numeric[p.column]]:
                ready[part] = open_parts.pop(part)
            open_parts, counts = _narrowed(rows, open_parts, counts, ranges, ready)
        keys: dict = {g: [None] * len(ks) for g, ks in ranks.items()}
        for (g, i), values in _ranked(rows, ready, len(order), ranges).items():
            keys[g][i] = values
        return sizes, keys
    finally:
        rows.unpersist()


def _narrowed(rows: DataFrame, parts: dict, counts: dict, ranges: int, ready: dict) -> tuple[dict, dict]:
    """One step for every open part: the ranges of its column that hold the wanted ranks."""
    if not parts:
        return {}, {}
    listed = list(parts)
    tags = [F.when(p.holds(ranges), F.struct(F.lit(i).alias("p"), _value(p.column).alias("v"))) for i, p in enumerate(listed)]
    spans = {listed[r["p"]]: (r["lo"], r["hi"]) for r in _tagged(rows, tags).groupBy("p").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    after: dict[Part, list] = {}
    known: dict[Part, int] = {}
    tags, steps = [], {}
    for i, p in enumerate(listed):
        lo, hi = spans[p]
        if lo is None:  # NULL alone: the next column decides
            after[p._replace(column=p.column + 1)], known[p._replace(column=p.column + 1)] = parts[p], counts[p]
            continue
        steps[i] = (p.column, lo, (hi - lo) / ranges or 1.0)
        tags.append(F.when(p.holds(ranges), F.struct(F.lit(i).alias("p"), _range(*steps[i], ranges).alias("b"))))
    seen = defaultdict(dict)
    if tags:
        for r in _tagged(rows, tags).groupBy("p", "b").agg(F.count(F.lit(1)).alias("n")).collect():
            seen[r["p"]][r["b"]] = r["n"]
    for i, step in steps.items():
        p, lo, hi = listed[i], *spans[listed[i]]
        for slot in parts[p]:
            below = 0
            for b in sorted(seen[i]):
                if below + seen[i][b] >= slot[2]:
                    break
                below += seen[i][b]
            n, here = seen[i][b], (slot[0], slot[1], slot[2] - below)
            # one value left (or the NULLs): the next column decides
            part = Part(p.group, (*p.steps, (*step, b)), p.column + 1 if b < 0 or lo == hi else p.column)
            if n == counts[p] and lo < hi:  # values that doubles don't tell apart
                ready.setdefault(part, []).append(here)
            else:
                after.setdefault(part, []).append(here)
                known[part] = n
    return after, known


def _ranked(rows: DataFrame, ready: dict, width: int, ranges: int) -> dict:
    """The rows at the wanted ranks of small parts: {(group, number of the rank): order values}."""
    listed = list(ready)
    if not listed:
        return {}
    values = [f"_o{j}" for j in range(width)]
    tags = [F.when(p.holds(ranges), F.struct(F.lit(i).alias("p"), *values)) for i, p in enumerate(listed)]
    ranked = _tagged(rows, tags).withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy(*values)))
    picks = [(i, k) for i, p in enumerate(listed) for _, _, k in ready[p]]
    hits = {(r["p"], r["k"]): tuple(r[c] for c in values) for r in ranked.filter(
        F.struct("p", "k").isin([F.struct(F.lit(i), F.lit(k)) for i, k in picks])).collect()}
    return {(g, n): hits[i, k] for i, p in enumerate(listed) for g, n, k in ready[p]}


def up_to(df: DataFrame, order: Sequence[str], key: tuple | None) -> Column:
    """True for rows at or before the row with these order values (NULLs first); False without one."""
    if key is None:
        return F.lit(False)
    return F.struct(*[F.col(c) for c in order]) <= F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, key, strict=True)])
