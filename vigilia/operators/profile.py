"""Table profiling and dataset suitability.

Every statistic is one aggregation pass with partial (map-side) aggregation;
per-column results are unpivoted from a single wide row. Exact quantiles are
bracketed by mergeable sketches and finished by counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _stack(df: DataFrame, names: Sequence[str], prefix_: str, out: str, key: str = "column_name") -> DataFrame:
    body = ", ".join(f"'{n}', `{prefix_}{n}`" for n in names)
    return df.selectExpr(f"stack({len(names)}, {body}) AS ({key}, {out})")


def shape(df: DataFrame) -> DataFrame:
    """Rows x columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def distinct_count(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct values; ``approx`` uses HyperLogLog++ (fixed memory at any scale)."""
    f = F.approx_count_distinct(col, rsd) if approx else F.countDistinct(col)
    return df.agg(f.cast("long").alias(f"n_distinct_{col}"))


def positives(df: DataFrame, target: str) -> DataFrame:
    """D3: positives and rate in percent."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(target).cast("long").alias("n_positive"),
                  F.round(F.avg(target) * 100, 6).alias("positive_pct"))


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Counts and percent per value; the total is a scalar subquery, not a global window."""
    d = df.filter(F.col(col).isNotNull()) if dropna else df
    counts = d.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = d.agg(F.count(F.lit(1))).scalar()  # scalar subquery, no global window
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 6))


def missing_report(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """NULL count and percent per column in one pass; optionally only columns with missing values."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.sum(F.col(c).isNull().cast("long")).alias(f"m_{c}") for c in cols])
    long = wide.selectExpr("_n", "stack({}, {}) AS (column_name, missing_count)".format(
        len(cols), ", ".join(f"'{c}', `m_{c}`" for c in cols)))
    out = long.select("column_name", F.col("missing_count").cast("long").alias("missing_count"),
                      F.round(F.col("missing_count") * 100.0 / F.col("_n"), 6).alias("missing_pct"))
    return out.filter(F.col("missing_count") > 0) if only_missing else out


def per_patient_positives(df: DataFrame, patient: str, target: str) -> DataFrame:
    """Unique positive patients, their share of patients and positive rows share."""
    pos = F.col(target) == 1
    return df.agg(
        F.countDistinct(patient).alias("n_patients"),
        F.countDistinct(F.when(pos, F.col(patient))).alias("n_positive_patients"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(pos, 1).otherwise(0)).cast("long").alias("n_positive_rows"),
    ).withColumns({
        "positive_patient_pct": F.round(F.col("n_positive_patients") * 100.0 / F.col("n_patients"), 6),
        "positive_row_pct": F.round(F.col("n_positive_rows") * 100.0 / F.col("n_rows"), 6),
    })


def target_correlations(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every feature with the target (one pass)."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"c_{c}") for c in features])
    long = _stack(wide, features, "c_", "corr", key="feature")
    return long.select("feature", F.round("corr", 6).alias("corr"))


def sorted_correlations(corr: DataFrame) -> DataFrame:
    """correlations in descending order with their rank (one row per feature; missing ones last)."""
    order = [F.col("corr").desc_nulls_last(), F.col("feature")]
    return corr.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy("rank")


def suitability(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """0-10 score (rows > 5000, >= 10 features, binary target, max missing < 25 %, max |corr| > 0.1)."""
    cols = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(target).alias("n_classes"),
        F.greatest(*[F.sum(F.col(c).isNull().cast("long")) for c in cols]).alias("max_missing")
        if len(cols) > 1 else F.sum(F.col(cols[0]).isNull().cast("long")).alias("max_missing"),
        F.greatest(*[F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))) for c in features])
        .alias("max_abs_corr"),
    )
    score = (F.when(F.col("n_rows") > 5000, 2).otherwise(0)
             + F.lit(2 if len(features) >= 10 else 0)
             + F.when(F.col("n_classes") == 2, 2).otherwise(0)
             + F.when(F.col("max_missing") < F.col("n_rows") * 0.25, 2).otherwise(0)
             + F.when(F.col("max_abs_corr") > 0.1, 2).otherwise(0))
    verdict = (F.when(F.col("score") >= 8, "EXCELLENT DATASET FOR ML TRAINING")
               .when(F.col("score") >= 6, "GOOD DATASET WITH MINOR CLEANING NEEDED")
               .otherwise("DATASET NEEDS MAJOR IMPROVEMENTS"))
    return (wide.withColumn("n_features", F.lit(len(features)).cast("long"))
            .withColumn("score", score).withColumn("verdict", verdict)
            .withColumn("max_abs_corr", F.round("max_abs_corr", 6)))


def leakage_warnings(df: DataFrame, suspicious: Sequence[str] = ("sepsis_risk_score",)) -> list[str]:
    """Schema check (no job)."""
    return [f"WARNING: {c} may cause data leakage" for c in suspicious if c in df.columns]


def leakage_report(df: DataFrame, target: str, cols: Sequence[str], suspicious: Sequence[str] = ("sepsis_risk_score",), cut: float = 0.9) -> DataFrame:
    """D9 with a correlation cut: (feature, reason, abs_corr) of the columns whose name is known to leak, or whose absolute
    correlation with the target reaches ``cut`` (both reasons: two rows). One aggregation pass."""
    wide = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias(f"r_{c}") for c in cols])
    found = _stack(wide, cols, "r_", "abs_corr", key="feature").withColumn("abs_corr", F.round("abs_corr", 6))
    reasons = F.array_compact(F.array(F.when(F.col("feature").isin(list(suspicious)), "name"), F.when(F.col("abs_corr") >= cut, "correlation")))
    return found.select("feature", F.explode(reasons).alias("reason"), "abs_corr")


def feature_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each feature (one pass)."""
    wide = df.agg(*[F.avg(c).alias(f"a_{c}") for c in cols])
    return _stack(wide, cols, "a_", "mean", key="feature").withColumn("mean", F.round("mean", 6))


SKETCH_K = 4096  # of the KLL sketches: ranks are off by about 0.1 %
SKETCH_ERROR = 0.004  # of the rank, as a share of all values: four times that
SMALL = 1 << 20  # values of a column that are counted one by one


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5, rounded: bool = True, small: int = SMALL) -> DataFrame:
    """Exact, linearly interpolated quantile per column (pandas / ``quantile_cont`` semantics), for all columns at once.

    One pass builds a mergeable KLL sketch of every column, whose rank bound brackets the quantile. A second pass counts
    the values below and up to the bracket's end; where it is more than one value, a third counts each value in it, combined in
    the tasks, and running sums of these counts hold the values at the one or two ranks of the quantile. Brackets of more than ``small`` values are narrowed by further sketches of the
    values inside first. No sort of the table, nothing written; two rows a column reach the driver. NULL and NaN are missing
    values; a column without values has no row.
    """
    out = f"q{q}" if q != 0.5 else "median"
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField(out, T.DoubleType())])
    picks = quantile_values(df, cols, q, small)
    return df.sparkSession.createDataFrame([(c, round(v, 6) if rounded else v) for c, v in picks.items()], schema)


def quantile_values(df: DataFrame, cols: Sequence[str], q: float = 0.5, small: int = SMALL) -> dict[str, float]:
    """{column: quantile} of :func:`exact_quantiles`."""
    x = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in cols}
    whole = (float("-inf"), float("inf"))
    brackets, sizes = _sketched(df, x, dict.fromkeys(cols, whole), q, dict.fromkeys(cols, None))
    ranks = {c: (n - 1) * q for c, n in sizes.items()}
    inside = {c: 2 * SKETCH_ERROR * n for c, n in sizes.items()}
    while wide := {c: b for c, b in brackets.items() if inside[c] > small and b[0] < b[1]}:
        narrower, held = _sketched(df, {c: x[c] for c in wide}, wide, q, {c: ranks[c] for c in wide})
        brackets |= narrower
        done = {c: narrower[c] == wide[c] for c in wide}  # a bracket of few, frequent values
        inside |= {c: 0 if done[c] else 2 * SKETCH_ERROR * held[c] for c in wide}
    found = _at_ranks(df, x, brackets, ranks)
    if missed := [c for c in sizes if c not in found]:  # the bound is one of probability
        found |= _at_ranks(df, {c: x[c] for c in missed}, dict.fromkeys(missed, whole), ranks)
    return {c: lo if lo == hi else lo + (ranks[c] - int(ranks[c])) * (hi - lo) for c in cols if c in found for lo, hi in [found[c]]}


def _sketched(df: DataFrame, x: dict, brackets: dict, q: float, ranks: dict) -> tuple[dict, dict]:
    """Narrower brackets from sketches of the values inside the given ones, and how many values these hold."""
    cols = list(x)
    inside = [F.when((x[c] >= F.lit(brackets[c][0])) & (x[c] <= F.lit(brackets[c][1])), x[c]) for c in cols]
    n = len(cols)
    # a sketch is some 100 kB, whatever the number of values
    row = df.agg(*[F.kll_sketch_agg_double(v, F.lit(SKETCH_K)) for v in inside], *[F.count(v) for v in inside],
                 *[F.count(F.when(x[c] < F.lit(brackets[c][0]), 1)) for c in cols]).first()
    sizes = {c: row[n + i] for i, c in enumerate(cols) if row[n + i]}
    at = []
    for c in sizes:
        i = cols.index(c)
        share = q if ranks[c] is None else (ranks[c] - row[2 * n + i]) / sizes[c]
        at += [F.kll_sketch_get_quantile_double(F.lit(bytes(row[i])), F.lit(max(0.0, min(1.0, share + d)))) for d in (-SKETCH_ERROR, SKETCH_ERROR)]
    ends = df.sparkSession.range(1).select(*[e.alias(f"e{j}") for j, e in enumerate(at)]).first() if at else []
    return {c: (ends[2 * i], ends[2 * i + 1]) for i, c in enumerate(sizes)}, sizes


def _at_ranks(df: DataFrame, x: dict, brackets: dict, ranks: dict) -> dict[str, tuple[float, float]]:
    """Values at the ranks around each column's quantile, where its bracket holds them."""
    if not brackets:
        return {}
    cols, below, upto = list(brackets), {}, {}
    row = df.agg(*[F.count(F.when(x[c] < F.lit(brackets[c][0]), 1)) for c in cols], *[F.count(F.when(x[c] <= F.lit(brackets[c][1]), 1)) for c in cols]).first()
    for i, c in enumerate(cols):
        below[c], upto[c] = row[i], row[len(cols) + i]
    held = {c for c in cols if below[c] <= int(ranks[c]) and math.ceil(ranks[c]) < upto[c]}
    found = {c: (brackets[c][0] + 0.0,) * 2 for c in cols if c in held and brackets[c][0] == brackets[c][1]}  # one value: counted already
    wide = [c for c in cols if c in held and c not in found]
    if not wide:
        return found
    inside = [F.when((x[c] >= F.lit(brackets[c][0])) & (x[c] <= F.lit(brackets[c][1])), F.struct(F.lit(i).alias("c"), x[c].alias("v"))) for i, c in enumerate(wide)]
    counts = df.select(F.explode(F.array_compact(F.array(*inside))).alias("t")).groupBy("t.c", "t.v").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # ranks within the bracket
    h = [F.element_at(F.array(*[F.lit(f(ranks[c]) - below[c]) for c in wide]), F.col("c") + 1) for f in (math.floor, math.ceil)]
    ranked = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    holds = [(F.col("before") <= k) & (k < F.col("before") + F.col("n")) for k in h]
    rows = ranked.select("c", "v", holds[0].alias("lo"), holds[1].alias("hi")).filter("lo or hi").collect()
    lo, hi = ({wide[r["c"]]: r["v"] for r in rows if r[k]} for k in ("lo", "hi"))
    return found | {c: (lo[c], hi[c]) for c in wide}


def class_ratio(df: DataFrame, target: str) -> DataFrame:
    """Negatives / positives (``scale_pos_weight``)."""
    return df.agg(F.sum(F.when(F.col(target) == 0, 1).otherwise(0)).cast("long").alias("n_negative"),
                  F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).cast("long").alias("n_positive")) \
        .withColumn("neg_pos_ratio", F.round(F.col("n_negative") / F.col("n_positive"), 6))


def split_distribution(df: DataFrame, split: str, target: str, all_label: str = "ALL") -> DataFrame:
    """Counts per split and class with subtotals (ROLLUP); subtotal keys are labelled ``all_label``."""
    r = df.rollup(split, target).agg(F.count(F.lit(1)).alias("n_rows"), F.grouping_id().alias("_g"))
    return r.select(
        F.when(F.col("_g") >= 2, all_label).otherwise(F.col(split)).alias(split),
        F.when(F.col("_g") >= 1, all_label).otherwise(F.col(target).cast("string")).alias(target), "n_rows")
