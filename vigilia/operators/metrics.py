"""Evaluation metrics (L1-L11) on scored tables, grouped by any key (model, stratum, ...).

* Counts-based metrics (confusion, P/R/F1, specificity, per-1000 impact,
  classification report) are one aggregation with partial aggregation.
* Ranking metrics (ROC-AUC with ties counted 1/2, step-wise average precision,
  curve points) group rows by distinct score first, then need cumulative counts
  per group in score order. A group (e.g. a model) holds all of its rows, so the
  running sums use the bucketed keyless prefix helper plus per-group offsets.
* Threshold search puts each row in its grid cell (number of grid thresholds
  <= score), counts per cell, and derives every threshold's confusion matrix
  from cumulative cell counts: no score x grid cross product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix


def long_scores(df: DataFrame, models: dict[str, str], label: str = "y", keep: Sequence[str] = ()) -> DataFrame:
    """(model, p, y, *keep): one row per (observation, model) from wide score columns (G4 stacking)."""
    body = ", ".join(f"'{m}', CAST(`{c}` AS DOUBLE)" for m, c in models.items())
    return df.selectExpr(*keep, f"CAST(`{label}` AS INT) AS y", f"stack({len(models)}, {body}) AS (model, p)")


def _safe_div(a: Column, b: Column) -> Column:
    """zero_division = 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, by: Sequence[str], threshold: float = 0.5, p: str = "p", y: str = "y") -> DataFrame:
    """L1: tn, fp, fn, tp per group at ``p >= threshold``."""
    pred = F.col(p) >= threshold
    pos = F.col(y) == 1
    cnt = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return df.groupBy(*by).agg(cnt(~pred & ~pos).alias("tn"), cnt(pred & ~pos).alias("fp"),
                               cnt(~pred & pos).alias("fn"), cnt(pred & pos).alias("tp"))


def rates(conf: DataFrame, digits: int = 6) -> DataFrame:
    """L2 + L11: accuracy, precision, recall (sensitivity), specificity, F1; zero division -> 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    out = conf.withColumns({
        "accuracy": _safe_div(tp + tn, tp + tn + fp + fn),
        "precision": prec,
        "recall": rec,
        "specificity": _safe_div(tn, tn + fp),
        "f1": _safe_div(2 * tp, 2 * tp + fp + fn),
    })
    return out.withColumns({c: F.round(c, digits) for c in ("accuracy", "precision", "recall", "specificity", "f1")})


def impact_per_1000(conf: DataFrame, digits: int = 6) -> DataFrame:
    """Septic, found, missed and false alarms per 1,000 scored patient-hours."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    per = lambda e: F.round(e * 1000.0 / n, digits)
    return conf.select("*", per(F.col("tp") + F.col("fn")).alias("septic_per_1000"),
                       per(F.col("tp")).alias("found_per_1000"), per(F.col("fn")).alias("missed_per_1000"),
                       per(F.col("fp")).alias("false_alarms_per_1000"),
                       per(F.col("tp") + F.col("fp")).alias("alerts_per_1000"))


def classification_report(conf: DataFrame, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Per class P / R / F1 / support, macro and weighted averages (long rows per group)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1 = _safe_div(2 * p1 * r1, p1 + r1)
    f0 = _safe_div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = {
        "0": (p0, r0, f0, s0),
        "1": (p1, r1, f1, s1),
        "macro avg": ((p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        "weighted avg": ((p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n),
    }
    wide = conf.select(*by, *[e.alias(f"_{i}_{j}") for i, (k, es) in enumerate(rows.items()) for j, e in enumerate(es)])
    body = ", ".join(f"'{k}', _{i}_0, _{i}_1, _{i}_2, _{i}_3" for i, k in enumerate(rows))
    long = wide.selectExpr(*by, f"stack({len(rows)}, {body}) AS (class_label, precision, recall, f1, support)")
    return long.select(*by, "class_label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                       F.col("support").cast("long").alias("support"))


def score_curve(df: DataFrame, by: Sequence[str], p: str = "p", y: str = "y", n_parts: int | None = None) -> DataFrame:
    """Per group and distinct score: pos, neg, pos_below, neg_below (scores < p), totals n_pos, n_neg.

    Rows are counted per distinct score first; with continuous scores that is a table
    as long as the rows, and the running sums are distributed all the same."""
    counts = df.groupBy(*by, p).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
                                     F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("long").alias("neg"))
    curve = prefix.group_running_sums(counts, by, [p], ["pos", "neg"], n_parts)
    return curve.withColumnsRenamed({"pos_total": "n_pos", "neg_total": "n_neg"})


def roc_auc(curve: DataFrame, by: Sequence[str], digits: int = 6) -> DataFrame:
    """L3: AUC = sum over scores of pos * (neg below + neg tied / 2) / (P * N); NULL when a class is empty."""
    num = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
    return curve.groupBy(*by).agg(
        F.round(num / F.nullif(F.first("n_pos") * F.first("n_neg"), F.lit(0)), digits).alias("roc_auc"))


def average_precision(curve: DataFrame, by: Sequence[str], digits: int = 6) -> DataFrame:
    """L4: step-wise AP = sum over thresholds (descending) of delta-recall * precision."""
    tp = F.col("n_pos") - F.col("pos_below")
    fp = F.col("n_neg") - F.col("neg_below")
    term = F.when(F.col("pos") > 0, (F.col("pos") / F.col("n_pos")) * (tp / (tp + fp)))
    return curve.groupBy(*by).agg(F.round(F.sum(term), digits).alias("average_precision"))


def curve_points(curve: DataFrame, by: Sequence[str], p: str = "p", digits: int = 6) -> DataFrame:
    """L5 + E10: for each distinct threshold (descending), cumulative TP / FP, FPR, TPR, precision, recall."""
    tp = F.col("n_pos") - F.col("pos_below")
    fp = F.col("n_neg") - F.col("neg_below")
    return curve.select(
        *by, F.col(p).alias("threshold"), tp.alias("tp_cum"), fp.alias("fp_cum"),
        F.round(_safe_div(fp, F.col("n_neg")), digits).alias("fpr"), F.round(_safe_div(tp, F.col("n_pos")), digits).alias("tpr"),
        F.round(tp / (tp + fp), digits).alias("precision"), F.round(_safe_div(tp, F.col("n_pos")), digits).alias("recall"),
        F.round(F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")), digits).alias("pr_baseline"))


# Threshold grids (percent start, stop inclusive, step) and the metric each script optimises.
GRIDS = {
    "g30_59_by1": (30, 59, 1),
    "g30_68_by2": (30, 68, 2),
    "g10_85_by5": (10, 85, 5),
    "g20_88_by2": (20, 88, 2),
    "g30_69_by1": (30, 69, 1),
}


def grid_values(spec: tuple[int, int, int]) -> list[float]:
    a, b, s = spec
    return [i / 1e2 for i in range(a, b + 1, s)]


def threshold_search(df: DataFrame, by: Sequence[str], grids: dict[str, tuple[int, int, int]] | None = None,
                     p: str = "p", y: str = "y", digits: int = 6) -> DataFrame:
    """L7 (+ C9): best threshold per group, grid and metric (f1, accuracy).

    Ties go to the lowest threshold (strict improvement in the reference loop);
    when every value is 0 the default 0.5 is returned.
    """
    grids = grids or GRIDS
    cells = {g: sum((F.when(F.col(p) >= t, 1).otherwise(0) for t in grid_values(spec)), F.lit(0))
             for g, spec in grids.items()}
    body = ", ".join(f"'{g}', _k_{i}" for i, g in enumerate(grids))
    wide = df.select(*by, F.col(y).alias("_y"), *[e.alias(f"_k_{i}") for i, e in enumerate(cells.values())])
    long = wide.selectExpr(*by, "_y", f"stack({len(grids)}, {body}) AS (grid, k)")
    hist = long.groupBy(*by, "grid", "k").agg(F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("pos"),
                                               F.sum(F.when(F.col("_y") == 1, 0).otherwise(1)).alias("neg"))
    # a row in cell k is predicted positive for thresholds i < k: expand cells to thresholds (tiny table)
    upto = F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))
    per_t = (hist.withColumn("i", F.explode(upto))
             .groupBy(*by, "grid", "i").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp")))
    totals = hist.groupBy(*by, "grid").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    grid_rows = [(g, i, t) for g, spec in grids.items() for i, t in enumerate(grid_values(spec))]
    spark = df.sparkSession
    gt = spark.createDataFrame(grid_rows, "grid string, i int, threshold double")
    full = (F.broadcast(gt).join(totals, on="grid")
            .join(per_t, on=[*by, "grid", "i"], how="left").fillna(0, subset=["tp", "fp"]))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("n_pos") - tp, F.col("n_neg") - fp
    full = full.withColumns({"f1": _safe_div(2 * tp, 2 * tp + fp + fn), "accuracy": _safe_div(tp + tn, F.col("n_pos") + F.col("n_neg"))})
    mets = full.selectExpr(*by, "grid", "threshold", "stack(2, 'f1', f1, 'accuracy', accuracy) AS (metric, value)")
    # highest value; among equal values the lowest threshold
    best = mets.groupBy(*by, "grid", "metric").agg(
        F.max(F.struct("value", (-F.col("threshold")).alias("neg_t"))).alias("b"))
    return best.select(*by, "grid", "metric",
                       F.when(F.col("b.value") > 0, -F.col("b.neg_t")).otherwise(F.lit(0.5)).alias("best_threshold"),
                       F.round(F.col("b.value"), digits).alias("best_value"))


def metric_differences(table: DataFrame, first: str, second: str) -> DataFrame:
    """One row per metric with both models' values, ``second`` less ``first``, and the better model by AUC."""
    metrics = ["accuracy", "f1", "precision", "recall", "roc_auc"]
    body = ", ".join(f"'{m}', {m}" for m in metrics)
    long = table.selectExpr("model", f"stack({len(metrics)}, {body}) AS (metric, value)")
    wide = long.groupBy("metric").pivot("model", [first, second]).agg(F.max("value"))
    gap = F.col(second) - F.col(first)
    auc = F.max(F.when(F.col("metric") == "roc_auc", gap)).over(Window.partitionBy(F.lit(1)))  # five rows
    best = F.when(auc > 0, "XGBoost").when(auc < 0, "Random Forest").otherwise("Both models perform similarly")
    return wide.select("metric", first, second, F.round(gap, 6).alias("difference"), best.alias("best_model"))
