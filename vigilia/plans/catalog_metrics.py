"""Queries: evaluation metrics on fixed scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import tables as T
from .expected import GRIDS
from .registry import query
from .sqlbase import with_views as W

MODELS = {"random_forest": "score_a", "xgboost": "score_b"}

LS = """ls AS (
  SELECT obs_id, sirs_score, CAST(y AS INTEGER) AS y, 'random_forest' AS model, score_a AS p FROM scored
  UNION ALL SELECT obs_id, sirs_score, CAST(y AS INTEGER) AS y, 'xgboost' AS model, score_b AS p FROM scored
)"""

CONF = """conf AS (
  SELECT model, CAST(SUM(CASE WHEN p < 5e-1 AND y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(SUM(CASE WHEN p >= 5e-1 AND y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(SUM(CASE WHEN p < 5e-1 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(SUM(CASE WHEN p >= 5e-1 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM ls GROUP BY model
)"""

CURVE = """cnt AS (
  SELECT model, p, CAST(SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
    CAST(SUM(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM ls GROUP BY model, p
), cur AS (
  SELECT *, CAST(COALESCE(SUM(pos) OVER w, 0) AS BIGINT) AS pos_below, CAST(COALESCE(SUM(neg) OVER w, 0) AS BIGINT) AS neg_below,
    CAST(SUM(pos) OVER (PARTITION BY model) AS BIGINT) AS n_pos, CAST(SUM(neg) OVER (PARTITION BY model) AS BIGINT) AS n_neg
  FROM cnt WINDOW w AS (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


def _sd(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0e0 ELSE ({a}) / ({b}) END"


RATES_SQL = f"""SELECT model, tn, fp, fn, tp,
  ROUND({_sd('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, ROUND({_sd('tp', 'tp + fp')}, 6) AS precision,
  ROUND({_sd('tp', 'tp + fn')}, 6) AS recall, ROUND({_sd('tn', 'tn + fp')}, 6) AS specificity,
  ROUND({_sd('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM conf"""


def LONG(spark, sf):
    return M.long_scores(T.scored(T.vitals(spark, sf)), MODELS, "y", keep=["obs_id", "sirs_score"])


@query("l1_l2_l11_confusion_rates", W("scored", extra=LS + ",\n" + CONF) + RATES_SQL)
def q_l1(spark, sf):
    """L1 + L2 + L11: confusion matrix, accuracy, precision, recall (sensitivity), specificity, F1 per model."""
    return M.rates(M.confusion(LONG(spark, sf), ["model"]))


@query("l3_roc_auc", W("scored", extra=LS + ",\n" + CURVE) + """SELECT model,
  ROUND(SUM(pos * (neg_below + neg * 5e-1)) / (MAX(n_pos) * MAX(n_neg)), 6) AS roc_auc FROM cur GROUP BY model""")
def q_l3(spark, sf):
    """L3: ROC-AUC with ties counted 1/2 (score groups + distributed running sums)."""
    return M.roc_auc(M.score_curve(LONG(spark, sf), ["model"]), ["model"])


@query("l4_average_precision", W("scored", extra=LS + ",\n" + CURVE) + """SELECT model,
  ROUND(SUM(CASE WHEN pos > 0 THEN (pos / n_pos) * ((n_pos - pos_below) / ((n_pos - pos_below) + (n_neg - neg_below))) END), 6)
    AS average_precision FROM cur GROUP BY model""")
def q_l4(spark, sf):
    """L4: PR-AUC as step-wise average precision."""
    return M.average_precision(M.score_curve(LONG(spark, sf), ["model"]), ["model"])


@query("l5_curve_points", W("scored", extra=LS + ",\n" + CURVE) + f"""SELECT model, p AS threshold,
  n_pos - pos_below AS tp_cum, n_neg - neg_below AS fp_cum,
  ROUND({_sd('n_neg - neg_below', 'n_neg')}, 6) AS fpr, ROUND({_sd('n_pos - pos_below', 'n_pos')}, 6) AS tpr,
  ROUND((n_pos - pos_below) / ((n_pos - pos_below) + (n_neg - neg_below)), 6) AS precision,
  ROUND({_sd('n_pos - pos_below', 'n_pos')}, 6) AS recall, ROUND(n_pos / (n_pos + n_neg), 6) AS pr_baseline FROM cur""")
def q_l5(spark, sf):
    """L5 + E10: ROC and PR curve points (cumulative TP / FP by descending score), PR baseline."""
    return M.curve_points(M.score_curve(LONG(spark, sf), ["model"]), ["model"])


def _report_sql():
    p1, r1 = _sd("tp", "tp + fp"), _sd("tp", "tp + fn")
    p0, r0 = _sd("tn", "tn + fn"), _sd("tn", "tn + fp")
    return W("scored", extra=LS + ",\n" + CONF + f""",
r AS (SELECT model, {p1} AS p1, {r1} AS r1, {p0} AS p0, {r0} AS r0, tp + fn AS s1, tn + fp AS s0 FROM conf),
f AS (SELECT *, {_sd('2 * p1 * r1', 'p1 + r1')} AS f1, {_sd('2 * p0 * r0', 'p0 + r0')} AS f0, s0 + s1 AS n FROM r),
u AS (
  SELECT model, '0' AS class_label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
  UNION ALL SELECT model, '1', p1, r1, f1, s1 FROM f
  UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
  UNION ALL SELECT model, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM f
)""") + """SELECT model, class_label, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM u"""


@query("l6_classification_report", _report_sql())
def q_l6(spark, sf):
    """Classification report (per class, macro and weighted averages)."""
    return M.classification_report(M.confusion(LONG(spark, sf), ["model"]), ["model"])


def _search_sql():
    grids = " UNION ALL ".join(f"SELECT '{g}' AS grid, r.range AS i, r.range / 1e2 AS threshold FROM range({a}, {b + 1}, {s}) r"
                               for g, (a, b, s) in GRIDS.items())
    return W("scored", extra=LS + f""",
g AS ({grids}),
c AS (SELECT l.model, g.grid, g.threshold,
  SUM(CASE WHEN l.p >= g.threshold AND l.y = 1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN l.p >= g.threshold AND l.y <> 1 THEN 1 ELSE 0 END) AS fp,
  SUM(CASE WHEN l.p < g.threshold AND l.y = 1 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN l.p < g.threshold AND l.y <> 1 THEN 1 ELSE 0 END) AS tn
  FROM ls l, g GROUP BY l.model, g.grid, g.threshold),
m AS (SELECT model, grid, threshold, 'f1' AS metric, {_sd('2 * tp', '2 * tp + fp + fn')} AS value FROM c
  UNION ALL SELECT model, grid, threshold, 'accuracy', {_sd('tp + tn', 'tp + tn + fp + fn')} FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY model, grid, metric ORDER BY value DESC, threshold ASC) AS rk FROM m)""") + \
        """SELECT model, grid, metric, CASE WHEN value > 0 THEN threshold ELSE 5e-1 END AS best_threshold,
  ROUND(value, 6) AS best_value FROM b WHERE rk = 1"""


@query("l7_threshold_search", _search_sql())
def q_l7(spark, sf):
    """L7 + C9: best threshold per model, grid and metric (ties -> lowest threshold; all zero -> 0.5)."""
    return M.threshold_search(LONG(spark, sf), ["model"])


@query("l8_model_comparison", W("scored", extra=LS + ",\n" + CONF + ",\n" + CURVE + """,
auc AS (SELECT model, ROUND(SUM(pos * (neg_below + neg * 5e-1)) / (MAX(n_pos) * MAX(n_neg)), 6) AS roc_auc FROM cur GROUP BY model),
rt AS (""" + RATES_SQL + ")") + """SELECT rt.model, accuracy, precision, recall, f1, roc_auc,
  roc_auc = MAX(roc_auc) OVER () AND MIN(roc_auc) OVER () < MAX(roc_auc) OVER () AS is_winner FROM rt JOIN auc ON rt.model = auc.model""")
def q_l8(spark, sf):
    """L8 + G4: model comparison table (stacked metric rows) and winner by AUC (none when the models tie)."""
    long = LONG(spark, sf)
    rt = M.rates(M.confusion(long, ["model"])).select("model", "accuracy", "precision", "recall", "f1")
    auc = M.roc_auc(M.score_curve(long, ["model"]), ["model"])
    t = rt.join(auc, on="model")  # one row per model on both sides
    every = Window.partitionBy(F.lit(1))
    return t.withColumn("is_winner", (F.col("roc_auc") == F.max("roc_auc").over(every)) & (F.min("roc_auc").over(every) < F.max("roc_auc").over(every)))


@query("l8_model_differences", W("scored", extra=LS + ",\n" + CONF + ",\n" + CURVE + """,
auc AS (SELECT model, ROUND(SUM(pos * (neg_below + neg * 5e-1)) / (MAX(n_pos) * MAX(n_neg)), 6) AS roc_auc FROM cur GROUP BY model),
rt AS (""" + RATES_SQL + """),
t AS (SELECT rt.model, accuracy, f1, precision, recall, roc_auc FROM rt JOIN auc ON rt.model = auc.model),
l AS (SELECT model, 'accuracy' AS metric, accuracy AS v FROM t UNION ALL SELECT model, 'f1', f1 FROM t UNION ALL SELECT model, 'precision', precision FROM t
  UNION ALL SELECT model, 'recall', recall FROM t UNION ALL SELECT model, 'roc_auc', roc_auc FROM t),
d AS (SELECT metric, MAX(CASE WHEN model = 'random_forest' THEN v END) AS random_forest, MAX(CASE WHEN model = 'xgboost' THEN v END) AS xgboost FROM l GROUP BY metric),
b AS (SELECT xgboost - random_forest AS g FROM d WHERE metric = 'roc_auc')""") + """SELECT metric, random_forest, xgboost,
  ROUND(xgboost - random_forest, 6) AS difference, (SELECT CASE WHEN g > 0 THEN 'XGBoost' WHEN g < 0 THEN 'Random Forest'
  ELSE 'Both models perform similarly' END FROM b) AS best_model FROM d""")
def q_l8_diff(spark, sf):
    """Difference per metric (boosted less forest) and the better model by AUC, or neither when they tie."""
    t = q_l8(spark, sf).drop("is_winner")
    return M.metric_differences(t, "random_forest", "xgboost")


STRATUM_SQL = "CASE WHEN sirs_score >= 2 THEN '2+' ELSE CAST(sirs_score AS VARCHAR) END"


@query("l9_metrics_by_sirs_stratum", W("scored", extra=LS.replace("FROM scored", f"FROM (SELECT *, {STRATUM_SQL} AS stratum FROM scored) s")
                                       .replace("SELECT obs_id, sirs_score,", "SELECT obs_id, stratum, sirs_score,") + """,
cnt AS (SELECT model, stratum, p, CAST(SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
    CAST(SUM(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM ls GROUP BY model, stratum, p),
cur AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model, stratum ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
    SUM(pos) OVER (PARTITION BY model, stratum) AS n_pos, SUM(neg) OVER (PARTITION BY model, stratum) AS n_neg FROM cnt),
auc AS (SELECT model, stratum, ROUND(SUM(pos * (neg_below + neg * 5e-1)) / NULLIF(MAX(n_pos) * MAX(n_neg), 0), 6) AS roc_auc
  FROM cur GROUP BY model, stratum),
cf AS (SELECT model, stratum, CAST(COUNT(*) AS BIGINT) AS n, SUM(CASE WHEN p >= 5e-1 AND y = 1 THEN 1 ELSE 0 END) AS tp,
  SUM(CASE WHEN p >= 5e-1 AND y <> 1 THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN p < 5e-1 AND y = 1 THEN 1 ELSE 0 END) AS fn
  FROM ls GROUP BY model, stratum)""") + f"""SELECT cf.model, cf.stratum, n, roc_auc, ROUND({_sd('tp', 'tp + fn')}, 6) AS recall,
  ROUND({_sd('tp', 'tp + fp')}, 6) AS precision FROM cf JOIN auc ON cf.model = auc.model AND cf.stratum = auc.stratum""")
def q_l9(spark, sf):
    """AUC, recall and precision per SIRS stratum (0, 1, >= 2)."""
    long = LONG(spark, sf).withColumn(
        "stratum", F.when(F.col("sirs_score") >= 2, "2+").otherwise(F.col("sirs_score").cast("string")))
    by = ["model", "stratum"]
    conf = M.rates(M.confusion(long, by)).select(*by, (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
                                                 "recall", "precision")
    auc = M.roc_auc(M.score_curve(long, by), by)
    return conf.join(auc, on=by)


@query("l10_impact_per_1000", W("scored", extra=LS + ",\n" + CONF) + """SELECT model, tn, fp, fn, tp,
  ROUND((tp + fn) * 1e3 / (tp + fp + fn + tn), 6) AS septic_per_1000, ROUND(tp * 1e3 / (tp + fp + fn + tn), 6) AS found_per_1000,
  ROUND(fn * 1e3 / (tp + fp + fn + tn), 6) AS missed_per_1000, ROUND(fp * 1e3 / (tp + fp + fn + tn), 6) AS false_alarms_per_1000,
  ROUND((tp + fp) * 1e3 / (tp + fp + fn + tn), 6) AS alerts_per_1000 FROM conf""")
def q_l10(spark, sf):
    """Impact per 1,000 patient-hours (septic, found, missed, false alarms, alerts)."""
    return M.impact_per_1000(M.confusion(LONG(spark, sf), ["model"]))
