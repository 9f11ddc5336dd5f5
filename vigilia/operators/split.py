"""Train / validation / test splits, resampling and class weights.

A split is a column, not three copies: ``split`` in {train, val, test}, written
with ``partitionBy("split")`` so readers prune to one split. Row assignment is
a pure function of ids (seeded hash), so a lost task recomputes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix
from . import select as SE


def id_hash(col: str | Column, mult: int = 48271, add: int = 11, mod: int = 10007) -> Column:
    """Seeded integer hash (same formula in SQL engines): ``(id * mult + add) % mod``."""
    c = F.col(col) if isinstance(col, str) else col
    return (c * mult + add) % mod


def split_by_bucket(df: DataFrame, bucket: str | Column, cuts: Sequence[int] = (70, 85),
                    names: Sequence[str] = ("train", "val", "test"), out: str = "split") -> DataFrame:
    """Hash-bucket split (0-99 buckets, cut points in percent). Stratified in expectation."""
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    expr = F.when(b < cuts[0], names[0])
    for cut, name in zip(cuts[1:], names[1:]):
        expr = expr.when(b < cut, name)
    return df.withColumn(out, expr.otherwise(names[len(cuts)]))


def stratified_split(df: DataFrame, label: str, order: Sequence[str], cuts_bp: Sequence[int] = (7000, 8500),
                     names: Sequence[str] = ("train", "val", "test"), out: str = "split",
                     n_parts: int | None = None) -> DataFrame:
    """Exact per-class counts.

    Rows are ordered inside their class by ``order`` (a seeded hash, then a unique id).
    ``cuts_bp`` are cumulative cut points in basis points: the row of 1-based
    rank r in a class of n rows goes to the first split with
    ``r * 10000 <= n * cut`` (integer arithmetic, no float drift). The rows at the cuts are found by radix selection
    (``select``), and every row is compared with them where it stands: no sort, no shuffle, nothing written. A NULL
    label is a class. With more than ``select.GROUPS`` classes rows are ranked by windows instead.
    """
    got = SE.keys_at_ranks(df, label, order, lambda n: [n * int(cut) // 10000 for cut in cuts_bp])
    if got is None:
        ranked = prefix.group_row_number(df, [label], order, "_rn", total="_n", n=n_parts)
        within = [F.col("_rn") * 10000 <= F.col("_n") * F.lit(int(cut)) for cut in cuts_bp]
        return ranked.withColumn(out, _first_of(within, names)).drop("_rn", "_n")
    keys = got[1]
    within = [_by_class(label, {g: SE.up_to(df, order, ks[i]) for g, ks in keys.items()}) for i in range(len(cuts_bp))]
    return df.withColumn(out, _first_of(within, names))


def _first_of(conditions: Sequence[Column], names: Sequence[str]) -> Column:
    expr = None
    for cond, name in zip(conditions, names):
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(names[len(conditions)])


def _by_class(label: str, values: dict) -> Column:
    """The value of the row's class (NULL is a class)."""
    return F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(g)), v) for g, v in values.items()], F.lit(None))


def patient_split(df: DataFrame, patient: str = "patient_id", cuts: Sequence[int] = (70, 85),
                  out: str = "split") -> DataFrame:
    """Leak-free split, all hours of a patient in one split (bucket of a patient-id hash)."""
    return split_by_bucket(df, id_hash(patient, 69621, 7, 10009) % 100, cuts, out=out)


def check_split(assigned: DataFrame, key: str = "obs_id", split: str = "split", source: DataFrame | None = None) -> DataFrame:
    """Sizes per split, rows assigned to more than one split, and rows missing from all splits."""
    per_key = assigned.groupBy(key).agg(F.countDistinct(split).alias("_k"))
    overlap = per_key.agg(F.sum(F.when(F.col("_k") > 1, 1).otherwise(0)).cast("long")).scalar()
    res = assigned.agg(
        F.count(F.lit(1)).alias("n_assigned"),
        *[F.sum(F.when(F.col(split) == s, 1).otherwise(0)).cast("long").alias(f"n_{s}") for s in ("train", "val", "test")],
    ).withColumn("n_overlap", overlap)
    if source is not None:
        missing = source.select(key).join(assigned.select(key), on=key, how="left_anti").agg(F.count(F.lit(1)))
        res = res.withColumn("n_missing", missing.scalar())
    return res


def upsample_minority(df: DataFrame, label: str, order: Sequence[str], n_parts: int | None = None) -> DataFrame:
    """I7 + G1: rows of smaller classes replicated to the majority's size exactly, the majority as it is.

    With M majority and m minority rows, every minority row gets ``M div m``
    copies and the first ``M mod m`` rows by seeded hash one more (no driver
    sampling, no per-row randomness to lose on a retry). ``copy_no`` numbers the copies.
    See :func:`resample_minority` for draws with replacement.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).limit(SE.GROUPS + 1).collect()}
    if len(counts) > SE.GROUPS:
        return _upsample_ranked(df, label, order, n_parts)
    most = max(counts.values(), default=0)
    got = SE.keys_at_ranks(df, label, order, lambda n: [most % n])
    copies = {g: F.lit(most // n) + SE.up_to(df, order, got[1][g][0]).cast("int") for g, n in counts.items()}
    k = _by_class(label, copies) if copies else F.lit(1)
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), k.cast("int"))))


def _upsample_ranked(df: DataFrame, label: str, order: Sequence[str], n_parts: int | None) -> DataFrame:
    """Many classes: the same copies from a distributed row number."""
    ranked = prefix.group_row_number(df, [label], order, "_rn", total="_n", n=n_parts)
    d = ranked.withColumn("_n_major", ranked.agg(F.max("_n")).scalar())
    copies = F.floor(F.col("_n_major") / F.col("_n")) + F.when(F.col("_rn") <= F.col("_n_major") % F.col("_n"), 1).otherwise(0)
    d = d.withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return d.drop("_rn", "_n", "_n_major")


def draw(number: str | Column, n: Column, seed: int = 42) -> Column:
    """Place 0 .. n - 1 of draw ``number``: a seeded MD5, so replays draw the same rows (same formula in SQL engines)."""
    text = F.concat(F.lit(f"{seed}:"), (F.col(number) if isinstance(number, str) else number).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % n


def resample_minority(df: DataFrame, label: str, order: Sequence[str], seed: int = 42) -> DataFrame:
    """I7 + G1, with replacement: the majority as it is, and as many draws from each smaller class.

    Draw j takes the class's row number ``draw(j)``. Row numbers (``order`` starts with a seeded hash) come from counts of
    equal ranges of the hash and a window per range; the draws are generated where they are counted, and rows meet their
    number of draws by row number. ``copy_no`` numbers a row's copies; rows that are not drawn vanish. At most
    ``select.GROUPS`` classes; a NULL label is a class.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).limit(SE.GROUPS + 1).collect()}
    if len(counts) > SE.GROUPS:
        raise ValueError(f"more than {SE.GROUPS} classes in {label}")
    if not counts:
        return df.withColumn("copy_no", F.lit(1))
    major = max(counts, key=lambda g: (counts[g], g is None, g if g is not None else 0))
    out = df.filter(F.col(label).eqNullSafe(F.lit(major))).withColumn("copy_no", F.lit(1))
    for g in [g for g in counts if g != major]:
        rows = prefix.bucket_row_number(df.filter(F.col(label).eqNullSafe(F.lit(g))), order, "_rn")
        times = df.sparkSession.range(counts[major]).select((draw("id", F.lit(counts[g]), seed) + 1).alias("_rn")).groupBy("_rn").agg(F.count(F.lit(1)).alias("_k"))
        rows = rows.join(times, "_rn").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int"))))
        out = out.unionByName(rows.drop("_rn", "_k"))
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """I8: ``balanced`` weights n / (k * n_c) per class (a k-row table)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    n_all, k = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return counts.select(label, "n", (n_all / (k * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach the balanced weight column; a NULL label is a class.

    Up to ``select.GROUPS`` classes the weights stand in the plan as literals (counted first), so rows stay where they are;
    more classes are joined."""
    weights = class_weights(df, label).select(F.col(label).alias("_wl"), F.col("weight").alias(out))
    held = weights.limit(SE.GROUPS + 1).collect()
    if len(held) > SE.GROUPS:
        return df.join(weights, F.col(label).eqNullSafe(F.col("_wl")), "left").drop("_wl")
    values = {r["_wl"]: F.lit(r[out]) for r in held}
    return df.withColumn(out, _by_class(label, values) if values else F.lit(None).cast("double"))


def shuffle_order(df: DataFrame, id_col: str, out: str = "position") -> DataFrame:
    """position of each row in a seeded shuffle (order of the id's hash, then the id), 1..N."""
    d = df.withColumn("_h", id_hash(id_col))
    return prefix.global_row_number(d, ["_h", id_col], out).drop("_h")
