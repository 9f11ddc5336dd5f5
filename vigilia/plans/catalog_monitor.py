"""Queries: monitoring series, history, current risk, system summary, metrics with defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import monitor as MO
from ..operators import partials as PT
from ..session import scratch_path
from ..sources import tables as T
from . import expected as E
from .registry import query
from .sqlbase import tier_sql
from .sqlbase import with_views as W

SERIES = """s AS (SELECT patient_id, obs_id, hour_from_admission, score_a, score_b, 4e-1 * score_a + 6e-1 * score_b AS e,
  row_number() OVER (PARTITION BY patient_id ORDER BY hour_from_admission, obs_id) - 1 AS r,
  COUNT(*) OVER (PARTITION BY patient_id) AS n FROM vitals)"""


def _trend_sql(src: str, val: str) -> str:
    d = f"(AVG(CASE WHEN r >= n - n // 4 THEN {val} END) - AVG(CASE WHEN r < n // 4 THEN {val} END))"
    return f"""SELECT patient_id, CAST(MAX(n) AS BIGINT) AS n_points,
  CASE WHEN MAX(n) >= 4 THEN ROUND({d}, 6) END AS trend_delta,
  CASE WHEN MAX(n) < 4 THEN 'stable' WHEN {d} > 5e-2 THEN 'declining' WHEN {d} < -5e-2 THEN 'improving' ELSE 'stable' END AS trend
FROM {src} GROUP BY patient_id"""


@query("n1_trend_per_patient", W("vitals", extra=SERIES) + _trend_sql("s", "e"))
def q_n1(spark, sf):
    """Quarter-over-quarter trend of the ensemble score per patient."""
    v = T.vitals(spark, sf).withColumn("e", MO.ensemble_series(None))
    return MO.trend(MO.with_position(v), "e")


def _alert_sql() -> str:
    t = "'t-' || CAST(n - r AS VARCHAR) || 'h'"
    return W("vitals", extra=SERIES) + f"""SELECT obs_id, CAST(n - r AS BIGINT) AS hours_before,
  (score_b > 7e-1 OR abs(score_b - score_a) > 2e-1) AS alert_triggered,
  CASE WHEN score_b > 7e-1 THEN 'XGBoost detects HIGH risk (' || printf('%.2f', score_b) || ') at ' || {t} || ' — immediate review'
       WHEN abs(score_b - score_a) > 2e-1 THEN 'Model divergence detected at ' || {t} || ' (RF=' || printf('%.2f', score_a)
         || ', XGB=' || printf('%.2f', score_b) || ')' END AS alert_message,
  ROUND(e, 6) AS ensemble_score, {tier_sql('e')} AS risk_level FROM s"""


@query("n2_spike_alerts", _alert_sql())
def q_n2(spark, sf):
    """N2 (+ N3 points): spike / divergence alert with message, ensemble score and tier per point."""
    pts = MO.series_points(MO.with_position(T.vitals(spark, sf)))
    return pts.select("obs_id", "hours_before", "alert_triggered", "alert_message",
                      F.round("ensemble_score", 6).alias("ensemble_score"), "risk_level")


@query("n3_monitoring_summary", W("vitals", extra="""l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
    ORDER BY hour_from_admission DESC, obs_id DESC) AS rk FROM vitals) x WHERE rk <= 24),
s AS (SELECT patient_id, 4e-1 * score_a + 6e-1 * score_b AS e, score_a, score_b, COUNT(*) OVER (PARTITION BY patient_id) AS n,
    COUNT(*) OVER (PARTITION BY patient_id) - rk AS r FROM l),
m AS (SELECT patient_id, r, CASE WHEN score_b > 7e-1
    THEN 'XGBoost detects HIGH risk (' || printf('%.2f', score_b) || ') at t-' || CAST(n - r AS VARCHAR) || 'h — immediate review'
    WHEN abs(score_b - score_a) > 2e-1 THEN 'Model divergence detected at t-' || CAST(n - r AS VARCHAR) || 'h (RF=' || printf('%.2f', score_a)
    || ', XGB=' || printf('%.2f', score_b) || ')' END AS msg, '-' || CAST(n - r AS VARCHAR) || 'h' AS t FROM s),
a AS (SELECT patient_id, CAST(COUNT(msg) AS BIGINT) AS total_alerts,
    COALESCE(string_agg(t || ': ' || msg, '; ' ORDER BY r) FILTER (WHERE msg IS NOT NULL), '') AS alert_list FROM m GROUP BY patient_id),
t AS (""" + _trend_sql("s", "e") + ")") + """SELECT t.patient_id, n_points AS total_data_points, total_alerts, trend, trend_delta, alert_list
FROM t JOIN a ON t.patient_id = a.patient_id""")
def q_n3(spark, sf):
    """Last-24-point monitoring summary per patient: points, alerts with time and message, trend."""
    d = MO.monitoring_summary(T.vitals(spark, sf))
    text = F.transform("alerts", lambda a: F.concat(a["time"], F.lit(": "), a["message"]))
    return d.withColumn("alert_list", F.array_join(text, "; ")).drop("alerts")


_N5 = W("plog") + f"""SELECT patient_id, risk_score AS current_risk_score,
  {tier_sql('risk_score')} AS current_risk_level, last_updated FROM (
  SELECT patient_id, risk_score, MAX(ts) OVER (PARTITION BY patient_id) AS last_updated,
    row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, obs_id DESC) AS rn FROM plog2) x WHERE rn = 1"""


@query("n5_current_risk", _N5)
def q_n5(spark, sf):
    """Current risk per patient from the prediction log (as-of latest)."""
    return MO.current_risk(T.prediction_log(T.vitals(spark, sf)))


_N4 = (W("plog", extra="""h AS (SELECT patient_id, obs_id, risk_score, ts,
    row_number() OVER (PARTITION BY patient_id ORDER BY ts, obs_id) - 1 AS r, COUNT(*) OVER (PARTITION BY patient_id) AS n,
    row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, obs_id DESC) AS rk FROM plog2),
t AS (""" + _trend_sql("h", "risk_score") + """),
c AS (SELECT patient_id, MAX(CASE WHEN rk = 1 THEN risk_score END) AS current_risk_score, MAX(ts) AS last_updated,
    CAST(SUM(CASE WHEN rk <= 24 THEN 1 ELSE 0 END) AS INTEGER) AS n_recent,
    string_agg(CASE WHEN rk <= 24 THEN CAST(obs_id AS VARCHAR) END, ',' ORDER BY ts, obs_id) AS recent_obs FROM h GROUP BY patient_id)""")
    + f"""SELECT c.patient_id, n_recent, recent_obs, current_risk_score, {tier_sql('current_risk_score')} AS current_risk_level,
  last_updated, trend, n_points FROM c JOIN t ON c.patient_id = t.patient_id""")


def _history_columns(h):
    return h.select("patient_id", F.size("predictions").alias("n_recent"),
                    F.array_join(F.transform("predictions", lambda x: x["obs_id"].cast("string")), ",").alias("recent_obs"),
                    "current_risk_score", "current_risk_level", "last_updated", "trend", "n_points")


@query("n4_patient_history", _N4)
def q_n4(spark, sf):
    """Patient history: last 24 predictions, current risk, trend over all predictions, last update."""
    return _history_columns(MO.patient_history(T.prediction_log(T.vitals(spark, sf))))


@query("n4_history_rows", W("plog") + """SELECT patient_id, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY ts, obs_id) AS BIGINT) AS seq,
  obs_id, ts, model_used, risk_score, risk_level FROM plog2""")
def q_n4_rows(spark, sf):
    """The full prediction history of every patient, in time order."""
    d = MO.history_rows(T.prediction_log(T.vitals(spark, sf)))
    return d.withColumn("seq", F.col("seq").cast("long"))


_D13 = W("plog") + """SELECT CASE WHEN GROUPING(model_used) = 1 THEN 'ALL' ELSE model_used END AS model_used,
  CASE WHEN GROUPING(risk_level) = 1 THEN 'ALL' ELSE risk_level END AS risk_level,
  CAST(COUNT(*) AS BIGINT) AS n_predictions, CAST(COUNT(DISTINCT patient_id) AS BIGINT) AS n_patients,
  CAST(SUM(CASE WHEN CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM plog2) THEN 1 ELSE 0 END) AS BIGINT) AS n_today,
  ROUND(AVG(risk_score), 6) AS avg_risk_score, ROUND(AVG(confidence), 6) AS avg_confidence,
  ROUND(COUNT(*) * 1e2 / (SELECT COUNT(*) FROM plog2), 6) AS pct_of_all
FROM plog2 GROUP BY CUBE (model_used, risk_level)"""


@query("d13_system_summary", _D13)
def q_d13(spark, sf):
    """System summary over the prediction log (CUBE of model x tier)."""
    return MO.system_summary(T.prediction_log(T.vitals(spark, sf)))


def _appended(spark, sf):
    """(log, partials) of the prediction log, appended in two batches by time."""
    log = T.prediction_log(T.vitals(spark, sf))
    path, partial = scratch_path(spark, "log"), scratch_path(spark, "log-partials")
    for part in (F.col("ts") < F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"), F.col("ts") >= F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")):
        PT.append_day(log.filter(part), path, partial)
    return spark.read.parquet(path), spark.read.parquet(partial)


@query("d13_incremental_summary", _D13)
def q_d13i(spark, sf):
    """D13 + A9: the summary from per-day partials, kept up while the log is appended in two batches that share a day."""
    return PT.summary(_appended(spark, sf)[1])


@query("n5_incremental_risk", _N5)
def q_n5i(spark, sf):
    """N5 + A9: current risk per patient from the per-day partials."""
    return PT.current_risk(_appended(spark, sf)[1])


@query("n4_incremental_history", _N4)
def q_n4i(spark, sf):
    """N4 + A9: patient history from the per-day partials and the log's days that a quarter's end or the list needs."""
    log, partials = _appended(spark, sf)
    return _history_columns(PT.history(partials, log))


A10_MODELS = ["random_forest", "xgboost", "logistic_regression"]


def _a10_sql():
    from .catalog_metrics import CONF, LS, RATES_SQL, CURVE
    dv = " UNION ALL ".join(f"SELECT '{m}' AS model, '{k}' AS metric, {v!r} AS default_value"
                            for m in A10_MODELS for k, v in E.MODEL_METRICS.items())
    return W("scored", extra=LS + ",\n" + CONF + ",\n" + CURVE + f""",
auc AS (SELECT model, ROUND(SUM(pos * (neg_below + neg * 5e-1)) / (MAX(n_pos) * MAX(n_neg)), 6) AS roc_auc FROM cur GROUP BY model),
rt AS ({RATES_SQL}),
cm AS (SELECT rt.model, accuracy, recall, specificity, roc_auc, f1, precision FROM rt JOIN auc ON rt.model = auc.model),
cl AS (SELECT model, 'accuracy' AS metric, accuracy AS value FROM cm UNION ALL SELECT model, 'sensitivity', recall FROM cm
  UNION ALL SELECT model, 'specificity', specificity FROM cm UNION ALL SELECT model, 'auc_roc', roc_auc FROM cm
  UNION ALL SELECT model, 'f1_score', f1 FROM cm UNION ALL SELECT model, 'precision', precision FROM cm),
dv AS ({dv})""") + """SELECT dv.model, dv.metric, COALESCE(cl.value, dv.default_value) AS value,
  CASE WHEN cl.value IS NOT NULL THEN 'computed' ELSE 'default' END AS source
FROM dv LEFT JOIN cl ON dv.model = cl.model AND dv.metric = cl.metric"""


def _computed_metrics(spark, sf):
    from .catalog_metrics import LONG
    long = LONG(spark, sf)
    rt = M.rates(M.confusion(long, ["model"]))
    auc = M.roc_auc(M.score_curve(long, ["model"]), ["model"])
    wide = rt.join(auc, on="model")
    return wide.selectExpr("model", "stack(6, 'accuracy', accuracy, 'sensitivity', recall, 'specificity', specificity, "
                               "'auc_roc', roc_auc, 'f1_score', f1, 'precision', precision) AS (metric, value)")


@query("a10_metrics_with_defaults", _a10_sql())
def q_a10(spark, sf):
    """A10: model metrics table with interface defaults where no computed value exists."""
    return MO.metrics_with_defaults(_computed_metrics(spark, sf), A10_MODELS)


@query("a10_metrics_files", _a10_sql())
def q_a10f(spark, sf):
    """A10: computed metrics written as a JSON file per model, a broken file for a third; read back with defaults."""
    computed = _computed_metrics(spark, sf)
    folder = scratch_path(spark, "metrics")
    for m in A10_MODELS[:2]:
        one = computed.filter(F.col("model") == m).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("metric", "value")))).alias("value"))
        one.coalesce(1).write.text(f"{folder}/{m}_metrics.json")
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.text(f"{folder}/{A10_MODELS[2]}_metrics.json")
    out = MO.metrics_from_files(spark, folder, A10_MODELS)
    return out.withColumn("source", F.when(F.col("source") == "file", "computed").otherwise(F.col("source")))
