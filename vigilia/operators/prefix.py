"""Running operations in a global order without a single-task window (H1).

``Window.orderBy(x)`` with no ``partitionBy`` moves every row to one task. Here
rows are range-partitioned by the order (``repartitionByRange``: Spark samples
the key itself and the sample's size follows the number of partitions) and each
row is stamped with its range's number. That table is checkpointed once in the
shared folder: the input is read for the sample and for the rows, and every
branch, retry and later job sees the same ranges. A running operation is then an
ordinary window inside a range plus exclusive running totals of a per-range
summary (one row per range and group).

Rows with equal keys stay in one range, so operations on values with many equal
rows (medians, score curves) count per value first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

# Line-number buckets have a fixed number of lines, so their number follows the data.
LINES_PER_BUCKET = 1 << 16


def ranged(df: DataFrame, order: Sequence[str], n: int | None = None, out: str = "_pid") -> DataFrame:
    """``df`` with ``out``, the number of the row's contiguous range of ``order``; materialised once."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return checkpoint(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()))


def _attach(d: DataFrame, summary: DataFrame, on: Sequence[str]) -> DataFrame:
    s = summary.withColumnsRenamed({c: f"_k_{c}" for c in on})
    cond = d["_pid"] == s["_k__pid"]
    for c in on:
        if c != "_pid":
            cond = cond & d[c].eqNullSafe(s[f"_k_{c}"])
    return d.join(s, cond).drop(*[f"_k_{c}" for c in on])


def group_running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str],
                       n: int | None = None) -> DataFrame:
    """Per ``by`` group in ``order``: ``{c}_below`` (sum over earlier rows) and ``{c}_total`` for each of ``cols``.

    Ranges are contiguous in (by, order), so the summary has at most ranges + groups rows.
    """
    d = ranged(df, [*by, *order], n)
    keys = ["_pid", *by]
    s = d.groupBy(*keys).agg(*[F.sum(c).alias(f"_s_{c}") for c in cols])
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    s = s.select(*keys, *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in cols],
                 *[F.sum(f"_s_{c}").over(whole).alias(f"{c}_total") for c in cols])
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_loc_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in cols})
    d = _attach(d, s, keys).withColumns({f"{c}_below": F.col(f"_loc_{c}") + F.col(f"_off_{c}") for c in cols})
    return d.drop("_pid", *[f"{p}_{c}" for c in cols for p in ("_loc", "_off")])


def group_row_number(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, total: str | None = None,
                     n: int | None = None) -> DataFrame:
    """1-based row number inside each ``by`` group in ``order``; ``total`` names the group's row count."""
    d = ranged(df, [*by, *order], n)
    keys = ["_pid", *by]
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(*keys, F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)).alias("_off"),
                 F.sum("_cnt").over(Window.partitionBy(*by)).alias("_all"))
    d = d.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    d = _attach(d, s, keys).withColumn(out, (F.col("_off") + F.col("_local")).cast("long"))
    if total:
        d = d.withColumn(total, F.col("_all"))
    return d.drop("_pid", "_local", "_off", "_all")


def bucket_row_number(df: DataFrame, order: Sequence[str], out: str, buckets: int = 4096) -> DataFrame:
    """1-based row number in ``order``, whose first column is a seeded hash (numbers that spread evenly, no NULL).

    Equal ranges of the hash are counted first (``buckets`` rows reach the driver and stand in the plan); rows are numbered in a
    window per range. One shuffle, no sample, nothing written."""
    first = F.col(order[0]).cast("double")
    lo, hi = df.agg(F.min(first), F.max(first)).first()
    if lo is None:
        return df.withColumn(out, F.lit(1).cast("long"))
    place = F.least(F.floor((first - F.lit(lo)) / F.lit((hi - lo) / buckets or 1.0)).cast("int"), F.lit(buckets - 1))
    counts = {r[0]: r[1] for r in df.groupBy(place).agg(F.count(F.lit(1))).collect()}
    before, offsets = 0, []
    for b in range(buckets):
        offsets.append(before)
        before += counts.get(b, 0)
    w = Window.partitionBy("_b").orderBy(*order)
    offset = F.element_at(F.expr(f"array({', '.join(f'{n}L' for n in offsets)})"), F.col("_b") + 1)
    return df.withColumn("_b", place).withColumn(out, F.row_number().over(w) + offset).drop("_b")


def global_row_number(df: DataFrame, order: Sequence[str], out: str, n: int | None = None) -> DataFrame:
    """1-based row number in ``order`` over the whole table (ties in arbitrary but dense order)."""
    return group_row_number(df, [], order, out, n=n)


def running_sums(df: DataFrame, order: Sequence[str], cols: Sequence[str], n: int | None = None,
                 suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``cols`` in ``order`` over the whole table."""
    d = group_running_sums(df, [], order, cols, n)
    return d.withColumns({f"{c}{suffix}": F.col(f"{c}_below") + F.coalesce(F.col(c), F.lit(0)) for c in cols}).drop(
        *[f"{c}_{s}" for c in cols for s in ("below", "total")])


def lag_scan_new_groups(df: DataFrame, order: str, value: str, out_flag: str, out_id: str,
                        n: int | None = None, dense: bool = False,
                        lines_per_bucket: int = LINES_PER_BUCKET) -> DataFrame:
    """E1 + E2 over a keyless order: a new group starts on the first row, when ``value`` falls below the
    previous row's value, or when either of the two is NULL; ``out_id`` is the running count of starts.

    One window per bucket decides all rows but the bucket's first; a summary with the bucket's first and
    last value and its inner starts decides the first rows and gives the offsets, all from one
    materialised table. ``dense``: ``order`` holds 1..N, so buckets are ranges of line numbers.
    """
    if dense:
        d = checkpoint(df.withColumn("_pid", F.floor((F.col(order) - 1) / F.lit(lines_per_bucket))))
    else:
        d = ranged(df, [order], n)

    def starts(prev: Column, cur: Column) -> Column:
        return F.when(prev.isNull() | cur.isNull() | (cur < prev), F.lit(1)).otherwise(F.lit(0))

    w = Window.partitionBy("_pid").orderBy(order)
    d = d.withColumn("_rn", F.row_number().over(w))
    d = d.withColumn("_inner", F.when(F.col("_rn") == 1, F.lit(0)).otherwise(starts(F.lag(value).over(w), F.col(value))))
    s = d.groupBy("_pid").agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"),
                              F.sum("_inner").alias("_n"))
    line = Window.orderBy("_pid")  # one row per bucket
    s = s.withColumn("_lead", starts(F.lag("_last").over(line), F.col("_first")))
    s = s.select("_pid", "_lead", F.coalesce(F.sum(F.col("_n") + F.col("_lead")).over(
        line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    d = d.withColumn("_cum", F.sum("_inner").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(s, on="_pid")
    return (d.withColumn(out_flag, F.when(F.col("_rn") == 1, F.col("_lead")).otherwise(F.col("_inner")))
            .withColumn(out_id, (F.col("_off") + F.col("_lead") + F.col("_cum")).cast("long"))
            .drop("_pid", "_rn", "_inner", "_lead", "_off", "_cum"))
