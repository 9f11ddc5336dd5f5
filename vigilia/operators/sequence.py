"""Skew-safe per-key sequence windows.

Most work in this engine is "per patient, in time order": stay rebuild, future
labels, change and rolling features, last-k readings. The natural plan is one
Exchange on ``patient_id`` and a sort, shared by all windows. That plan puts a
whole patient in one task; if one key holds a large share of all rows that task
becomes the job.

``sequence_windows`` keeps the one-Exchange plan for ordinary keys and splits
hot keys (more than ``hot_rows`` rows; found by a pre-aggregated count, so the
hot-key table has at most ``total_rows / hot_rows`` entries and is broadcast
with a proven bound) into chunks:

* RANGE frames over an hour column (look back / ahead a fixed number of hours)
  run on hour chunks. A row near a chunk edge is copied to the neighbour chunk
  (halo) so every owned row sees its whole frame; only owned rows are kept.
* ROWS frames (lag, lead, trailing means) need the exact ordinal within the key.
  It is rebuilt from per-chunk counts (a small table, cumulative sum by window)
  plus a local running count; hot rows are then re-chunked by ordinal with a row
  halo and the ROWS columns are recomputed there.

The input is split by key first: ordinary rows keep the plain plan, and only hot
rows take these steps.

Both paths give identical results; tests compare them on real fixtures.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WindowFn = Callable[[DataFrame, list], DataFrame]

# Default share of rows that makes a key "hot". Keys above this many rows are
# split; at most total_rows / HOT_ROWS keys can qualify.
HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows (partial aggregation before the shuffle)."""
    return (df.select(key).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > F.lit(hot_rows)).select(key))


# Above this many hot keys the tag is a broadcast join instead of a literal IN set (same rows either way).
HOT_LIST_MAX = 10_000
_HOT_CACHE: dict = {}


def hot_key_values(df: DataFrame, key: str, hot_rows: int) -> list | None:
    """Hot keys as a driver-side list (at most ``HOT_LIST_MAX``), or None when there are more.

    One aggregation job over the key column only (Catalyst prunes the rest of
    the plan); the result is bounded by ``rows / hot_rows`` and cached per plan.
    """
    probe = df.select(key)
    k = (df.sparkSession.sparkContext.applicationId, probe.semanticHash(), key, hot_rows)
    if k not in _HOT_CACHE:
        rows = hot_keys(df, key, hot_rows).limit(HOT_LIST_MAX + 1).collect()
        _HOT_CACHE[k] = None if len(rows) > HOT_LIST_MAX else [r[0] for r in rows]
    return _HOT_CACHE[k]


def tag_hot(df: DataFrame, key: str, hot_rows: int | None) -> tuple[DataFrame, bool]:
    """Add boolean ``_hot`` (never NULL); returns (frame, any_hot). The NULL key is a key like any other.

    Few hot keys: a literal IN set. Many: a broadcast join with the hot-key table,
    whose size is bounded by rows / hot_rows.
    """
    if hot_rows is None:
        return df.withColumn("_hot", F.lit(False)), False
    vals = hot_key_values(df, key, hot_rows)
    if vals == []:
        return df.withColumn("_hot", F.lit(False)), False
    if vals is not None:
        hot = F.coalesce(F.col(key).isin([v for v in vals if v is not None]), F.lit(False))
        return df.withColumn("_hot", hot | F.col(key).isNull() if None in vals else hot), True
    hk = hot_keys(df, key, hot_rows).select(F.col(key).alias("_hk"), F.lit(True).alias("_is_hot"))
    return (df.join(F.broadcast(hk), F.col(key).eqNullSafe(F.col("_hk")), "left")
            .withColumn("_hot", F.coalesce(F.col("_is_hot"), F.lit(False))).drop("_hk", "_is_hot")), True


def _plain(df: DataFrame, key: str, order_cols: list, seq_col: str | None, range_fn, rows_fn, len_col: str | None = None) -> DataFrame:
    """One Exchange on the key shared by all windows. The explicit repartition is that Exchange (the
    windows reuse it); it also spreads a single input split."""
    out = df.repartition(key)
    if seq_col:
        out = out.withColumn(seq_col, F.row_number().over(Window.partitionBy(key).orderBy(*order_cols)) - 1)
    if len_col:
        out = out.withColumn(len_col, F.count(F.lit(1)).over(Window.partitionBy(key)))
    if range_fn:
        out = range_fn(out, [key])
    if rows_fn:
        out = rows_fn(out, [key])
    return out


# Rows without an order value come first in their key, like in a plain window, in a chunk of their own.
_NO_HOUR = -(1 << 62)


def sequence_windows(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    *,
    chunk_basis: Column | None = None,
    range_fn: WindowFn | None = None,
    rows_fn: WindowFn | None = None,
    range_back: float = 0,
    range_fwd: float = 0,
    rows_back: int = 0,
    rows_fwd: int = 0,
    seq_col: str | None = None,
    len_col: str | None = None,
    hot_rows: int | None = HOT_ROWS,
    hour_chunk: float = 168.0,
    row_chunk: int = 8192,
) -> DataFrame:
    """Apply per-key window functions, splitting hot keys.

    ``range_fn(d, parts)`` adds columns from RANGE frames over the hour column,
    reaching at most ``range_back`` / ``range_fwd`` hours; ``rows_fn(d, parts)``
    adds columns from ROWS frames ordered by ``order``, reaching at most
    ``rows_back`` / ``rows_fwd`` rows. Both must use ``Window.partitionBy(*parts)``.
    ``chunk_basis`` is a numeric expression non-decreasing in ``order`` (usually
    the hour); ``seq_col`` names an optional 0-based ordinal output, ``len_col`` (with it) the key's number of rows.
    """
    order_cols = [F.col(c) for c in order]
    tagged, any_hot = tag_hot(df, key, hot_rows)
    if not any_hot:
        return _plain(df, key, order_cols, seq_col, range_fn, rows_fn, len_col)

    assert chunk_basis is not None, "chunk_basis is needed to split hot keys"
    assert row_chunk >= max(rows_back, rows_fwd, 1)
    base_cols = df.columns
    normal = _plain(tagged.filter(~F.col("_hot")).drop("_hot"), key, order_cols, seq_col, range_fn, rows_fn, len_col)

    # Only hot rows take the steps below.
    d = tagged.filter("_hot").drop("_hot").withColumn("_basis", chunk_basis.cast("double"))
    d = d.withColumn("_hc", F.coalesce(F.floor(F.col("_basis") / F.lit(float(hour_chunk))).cast("long"), F.lit(_NO_HOUR)))
    pos = F.col("_basis") - F.col("_hc") * F.lit(float(hour_chunk))
    none = F.array().cast("array<long>")
    parts = F.array(F.col("_hc"))
    if range_fwd > 0:
        parts = F.concat(parts, F.when(pos < range_fwd, F.array(F.col("_hc") - 1)).otherwise(none))
    if range_back > 0:
        parts = F.concat(parts, F.when(pos >= hour_chunk - range_back, F.array(F.col("_hc") + 1)).otherwise(none))
    d = d.withColumn("_part", F.explode(parts)).withColumn("_own", F.col("_part") == F.col("_hc"))
    pkeys = [key, "_part"]

    # Pass 1: one Exchange on (key, _part).
    w_local = Window.partitionBy(*pkeys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    hot = d.withColumn("_local", F.sum(F.col("_own").cast("long")).over(w_local) - 1)
    if range_fn:
        hot = range_fn(hot, pkeys)
    hot = hot.filter("_own")
    if seq_col or rows_fn:
        # Offsets of each hot chunk: counts per (key, chunk) -> running sum (small table).
        earlier = Window.partitionBy(key).orderBy("_hc").rowsBetween(Window.unboundedPreceding, -1)
        offs = d.filter("_own").groupBy(key, "_hc").agg(F.count(F.lit(1)).alias("_cn")).select(
            F.col(key).alias("_ok"), F.col("_hc").alias("_oc"), F.coalesce(F.sum("_cn").over(earlier), F.lit(0)).alias("_off"),
            F.sum("_cn").over(Window.partitionBy(key)).alias("_len"))
        hot = hot.join(offs, F.col(key).eqNullSafe(F.col("_ok")) & (F.col("_hc") == F.col("_oc")), "left")
        hot = hot.withColumn("_seq", F.col("_local") + F.col("_off"))
        if seq_col:
            hot = hot.withColumn(seq_col, F.col("_seq"))
        if len_col:
            hot = hot.withColumn(len_col, F.col("_len"))
    if rows_fn:
        # Pass 2: re-chunk by ordinal with a row halo, compute ROWS columns.
        hot = hot.withColumn("_rc", F.floor(F.col("_seq") / F.lit(row_chunk)).cast("long"))
        rpos = F.col("_seq") - F.col("_rc") * F.lit(row_chunk)
        rparts = F.array(F.col("_rc"))
        if rows_fwd > 0:
            rparts = F.concat(rparts, F.when(rpos < rows_fwd, F.array(F.col("_rc") - 1)).otherwise(none))
        if rows_back > 0:
            rparts = F.concat(rparts, F.when(rpos >= row_chunk - rows_back, F.array(F.col("_rc") + 1)).otherwise(none))
        hot = hot.withColumn("_rpart", F.explode(rparts))
        hot = rows_fn(hot, [key, "_rpart"]).filter(F.col("_rpart") == F.col("_rc"))
    keep = base_cols + [c for c in normal.columns if c not in base_cols]
    return normal.select(*keep).unionByName(hot.select(*keep))


def ordinal_within(df: DataFrame, key: str, order: Sequence[str], out: str, *,
                   chunk_basis: Column | None = None, hot_rows: int | None = HOT_ROWS,
                   hour_chunk: float = 168.0, length: str | None = None) -> DataFrame:
    """0-based position of each row within its key in ``order`` (row_number - 1), skew-safe; ``length`` names the
    key's number of rows."""
    return sequence_windows(df, key, order, chunk_basis=chunk_basis, seq_col=out, len_col=length,
                            hot_rows=hot_rows, hour_chunk=hour_chunk)


def top_k_per_key(df: DataFrame, key: str, order: Sequence[Column], k: int, *,
                  chunk_basis: Column | None = None, hot_rows: int | None = HOT_ROWS,
                  hour_chunk: float = 168.0, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per key in ``order`` (e.g. latest readings), with a 1-based rank.

    Two stages: a top-k inside (key, chunk) — hot keys are chunked, ordinary keys
    are one chunk — then a top-k over the survivors, at most k rows per chunk.
    No task ever ranks a whole hot key.
    """
    d, any_hot = tag_hot(df, key, hot_rows)
    if not any_hot:
        w = Window.partitionBy(key).orderBy(*order)
        return df.repartition(key).withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
    assert chunk_basis is not None
    d = d.withColumn("_hc", F.when(F.col("_hot"), F.floor(chunk_basis.cast("double") / F.lit(float(hour_chunk))))
                     .otherwise(F.lit(0)).cast("long"))
    stage1 = d.withColumn("_r1", F.row_number().over(Window.partitionBy(key, "_hc").orderBy(*order)))
    stage1 = stage1.filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(key).orderBy(*order)
    out = stage1.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
    return out.drop("_hot", "_hc", "_r1")
