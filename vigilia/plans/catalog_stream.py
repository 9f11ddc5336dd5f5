"""Queries: streaming (S1-S5) and documented-only operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import drift as DR
from ..operators import features as FE
from ..operators import metrics as M
from ..sources import tables as T
from ..streaming import scoring as ST
from . import feed
from .expected import CLIPS
from .registry import query
from .sqlbase import with_views as W


_LEVEL = """CASE WHEN score_b >= 85e-2 THEN 'CRITICAL' WHEN score_b >= 7e-1 THEN 'HIGH' WHEN score_b >= 5e-1 THEN 'MODERATE' ELSE 'LOW' END"""


@query("s1_streaming_scores", W("sv") + f"""SELECT sv.obs_id, sv.patient_id, e.ts, CAST(sirs_score AS INTEGER) AS sirs_score, sirs_positive,
  {_LEVEL} AS risk_level, (score_b > 7e-1 OR abs(score_b - score_a) > 2e-1) AS alert FROM sv JOIN events e ON e.event_id = sv.obs_id""")
def q_s1(spark, sf):
    """File stream (events in deliveries by time) -> SIRS, tier, alert per row, foreachBatch sink."""
    return feed.scores(spark, sf)


_TREND = ["heart_rate", "respiratory_rate", "temperature_c", "systolic_bp", "lactate"]


@query("s2_streaming_trends", W("vitals") + "SELECT obs_id, patient_id, e.ts, " + ", ".join(
    f"COALESCE({c} - LAG({c}) OVER w, 0e0) AS {c}_change, ROUND(AVG({c}) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS {c}_rolling_mean"
    for c in _TREND) + " FROM vitals JOIN events e ON e.event_id = obs_id WINDOW w AS (PARTITION BY patient_id ORDER BY e.ts, obs_id)")
def q_s2(spark, sf):
    """Stateful change and 3-row mean per patient; a third of the rows arrive 1 h late, some in a later micro-batch."""
    rows = feed.trends(T.table(spark, sf, "events"), late=F.col("event_id") % 3 == 0)
    return rows.select("obs_id", "patient_id", "ts", *[x for c in K.TREND_VITALS for x in (
        F.col(f"{c}_change"), F.round(F.nanvl(f"{c}_rolling_mean", F.lit(None).cast("double")), 6).alias(f"{c}_rolling_mean"))])


# Late: the repeated rows of the first slice, and of the last slice those at or before the watermark (its end less 2 h).
@query("s3_dedup_late", """WITH b AS (SELECT MIN(ts) AS lo, MAX(ts) AS hi FROM events),
again AS (SELECT ts FROM events, b WHERE (ts < lo + (hi - lo) / 4 AND event_id % 5 = 0) OR (ts >= lo + (hi - lo) / 4 * 3 AND event_id % 7 = 0))
SELECT MIN(event_id) AS event_id, user_id, ts,
  CAST((SELECT COUNT(*) FROM again, b WHERE again.ts <= hi - INTERVAL 2 HOUR) AS INTEGER) AS late_rows_dropped FROM events GROUP BY user_id, ts""")
def q_s3(spark, sf):
    """S3: watermark + dropDuplicatesWithinWatermark on a stream with late rows and duplicates."""
    rows, dropped = feed.dedup_late(spark, sf)
    return rows.withColumn("late_rows_dropped", F.lit(dropped))


@query("s4_streaming_alert_windows", """SELECT date_trunc('hour', ts) AS window_start, CAST(COUNT(*) AS BIGINT) AS n_alerts FROM events
WHERE ((event_id*73+29)%1000)/1e3 > 7e-1 OR abs(((event_id*73+29)%1000)/1e3 - ((event_id*37+11)%1000)/1e3) > 2e-1 GROUP BY 1""")
def q_s4s(spark, sf):
    """S4 (stream): watermarked tumbling 1 h alert counts in append mode."""
    rows = feed.alert_windows(T.table(spark, sf, "events"))
    return rows.filter("kind = '1h'").select("window_start", "n_alerts")


@query("s5_streaming_label", """WITH o AS (SELECT event_id AS obs_id, user_id AS patient_id, ts,
  ((event_id*101+13)%1000)*((event_id*211+7)%1000)/1e6 >= 7e-1 AS onset FROM events)
SELECT obs_id, patient_id, ts, CASE WHEN EXISTS (SELECT 1 FROM o r WHERE r.onset AND r.patient_id = o.patient_id
  AND r.ts > o.ts AND r.ts <= o.ts + INTERVAL 6 HOUR) THEN 1 ELSE 0 END AS sepsis_next_6h_time FROM o""")
def q_s5(spark, sf):
    """Stream-stream left outer interval join for 'sepsis within 6 h' by event time."""
    return feed.label(spark, sf)


ALERT = "(((event_id*73+29)%1000)/1e3 > 7e-1 OR abs(((event_id*73+29)%1000)/1e3 - ((event_id*37+11)%1000)/1e3) > 2e-1)"


_WINDOWS = "WITH a AS (SELECT ts FROM events WHERE " + ALERT + """)
SELECT '1h' AS kind, date_trunc('hour', ts) AS window_start, CAST(COUNT(*) AS BIGINT) AS n_alerts FROM a GROUP BY 2
UNION ALL
SELECT '6h/1h', window_start, CAST(COUNT(*) AS BIGINT) FROM (
  SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS window_start FROM a, range(0, 6) r(k)) s GROUP BY 2"""


@query("s4_alert_windows_batch", _WINDOWS)
def q_s4(spark, sf):
    """S4 (batch form): tumbling 1 h and sliding 6 h / 1 h alert counts."""
    return ST.alert_windows(ST.observations(T.table(spark, sf, "events"), for_watermark=False))


_STAYS = """WITH e AS (SELECT user_id AS patient_id, ts,
  CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
         OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 24 HOUR THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY patient_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT patient_id, MIN(ts) AS stay_start, MAX(ts) + INTERVAL 24 HOUR AS stay_end, CAST(COUNT(*) AS BIGINT) AS n_obs
FROM s GROUP BY patient_id, sid"""


@query("s4_streaming_sliding_windows", _WINDOWS)
def q_s4_sliding(spark, sf):
    """S4 (stream): tumbling 1 h and sliding 6 h / 1 h alert counts; a third of the rows arrive 1 h late."""
    return feed.alert_windows(T.table(spark, sf, "events"), late=F.col("event_id") % 3 == 0)


@query("s4_streaming_stays", _STAYS)
def q_s4_stays(spark, sf):
    """S4 (stream): stays as session windows in append mode; a seventh of the rows arrive 30 h late and may join two sessions."""
    return feed.stays(T.table(spark, sf, "events"), late=F.col("event_id") % 7 == 0, late_hours=30)


@query("s4_stays_session_windows", _STAYS)
def q_s4_sessions(spark, sf):
    """Stays as session windows (a new stay after 24 h without readings)."""
    return ST.stays_by_session(ST.observations(T.table(spark, sf, "events"), for_watermark=False))


# ------------------------------------------------------------------ Z1-Z7
@query("z1_standard_scale", W("vitals") + """SELECT obs_id,
  ROUND((heart_rate - (SELECT AVG(heart_rate) FROM vitals WHERE split_bucket < 70))
        / (SELECT stddev_samp(heart_rate) FROM vitals WHERE split_bucket < 70), 6) AS heart_rate,
  ROUND((lactate - (SELECT AVG(lactate) FROM vitals WHERE split_bucket < 70))
        / (SELECT stddev_samp(lactate) FROM vitals WHERE split_bucket < 70), 6) AS lactate FROM vitals""")
def q_z1(spark, sf):
    """Standard scaling with statistics of the training split (scalar subqueries)."""
    v = T.vitals(spark, sf)
    s = FE.standard_scale(v, ["heart_rate", "lactate"], fit=v.filter(F.col("split_bucket") < 70))
    return s.select("obs_id", F.round("heart_rate", 6).alias("heart_rate"), F.round("lactate", 6).alias("lactate"))


@query("z2_forward_fill", W("vitals") + """SELECT obs_id,
  last_value(lactate IGNORE NULLS) OVER w AS lactate, last_value(temperature_c IGNORE NULLS) OVER w AS temperature_c,
  last_value(hemoglobin IGNORE NULLS) OVER w AS hemoglobin FROM vitals
WINDOW w AS (PARTITION BY patient_id ORDER BY hour_from_admission, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_z2(spark, sf):
    """Forward fill within the patient."""
    v = FE.forward_fill(T.vitals(spark, sf), ["lactate", "temperature_c", "hemoglobin"])
    return v.select("obs_id", "lactate", "temperature_c", "hemoglobin")


@query("z3_interaction", W("vitals") + "SELECT obs_id, lactate * wbc_count AS lactate_x_wbc_count FROM vitals")
def q_z3(spark, sf):
    """Z3: interaction term lactate x WBC."""
    return FE.interaction(T.vitals(spark, sf)).select("obs_id", "lactate_x_wbc_count")


@query("z4_hourly_rolling", W("vitals") + """SELECT obs_id,
  ROUND(AVG(heart_rate) OVER w, 6) AS heart_rate_mean_4h, ROUND(regr_slope(heart_rate, CAST(hour_from_admission AS DOUBLE)) OVER w, 6)
    AS heart_rate_slope_4h FROM vitals
WINDOW w AS (PARTITION BY patient_id ORDER BY hour_from_admission RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def q_z4(spark, sf):
    """4-hour rolling mean and slope (RANGE frame on the hour; hot patients chunked with a halo)."""
    d = FE.hourly_rolling(T.vitals(spark, sf), "heart_rate", 4)
    return d.select("obs_id", F.round("heart_rate_mean_4h", 6).alias("heart_rate_mean_4h"),
                    F.round("heart_rate_slope_4h", 6).alias("heart_rate_slope_4h"))


DRIFT_COLS = ["heart_rate", "lactate", "wbc_count"]


def _psi_sql(c, lo, hi):
    b = f"LEAST(GREATEST(FLOOR(({c} - {lo!r}) / ({hi!r} - {lo!r}) * 10), 0), 9)"
    return f"""SELECT '{c}' AS feature, ROUND(SUM((pn - pr) * LN(pn / pr)), 6) AS psi FROM (
  SELECT g.bin, GREATEST(COALESCE(r.p, 0), 1e-6) AS pr, GREATEST(COALESCE(n.p, 0), 1e-6) AS pn FROM range(0, 10) g(bin)
  LEFT JOIN (SELECT {b} AS bin, COUNT(*) / (SELECT COUNT({c}) FROM vitals WHERE split_bucket < 70) AS p FROM vitals
             WHERE split_bucket < 70 AND {c} IS NOT NULL GROUP BY 1) r ON g.bin = r.bin
  LEFT JOIN (SELECT {b} AS bin, COUNT(*) / (SELECT COUNT({c}) FROM vitals WHERE split_bucket >= 85) AS p FROM vitals
             WHERE split_bucket >= 85 AND {c} IS NOT NULL GROUP BY 1) n ON g.bin = n.bin) t"""


def _ks_sql(c):
    return f"""SELECT '{c}' AS feature, ROUND(MAX(abs(cr / tr - cn / tn)), 6) AS ks FROM (
  SELECT SUM(r) OVER (ORDER BY x) AS cr, SUM(n) OVER (ORDER BY x) AS cn, SUM(r) OVER () AS tr, SUM(n) OVER () AS tn FROM (
    SELECT {c} AS x, SUM(CASE WHEN split_bucket < 70 THEN 1 ELSE 0 END) AS r, SUM(CASE WHEN split_bucket >= 85 THEN 1 ELSE 0 END) AS n
    FROM vitals WHERE {c} IS NOT NULL AND (split_bucket < 70 OR split_bucket >= 85) GROUP BY {c}) g) t"""


@query("z5_drift_psi_ks", W("vitals") + "SELECT p.feature, psi, ks FROM (" + " UNION ALL ".join(
    _psi_sql(c, *CLIPS[c]) for c in DRIFT_COLS) + ") p JOIN (" + " UNION ALL ".join(
    _ks_sql(c) for c in DRIFT_COLS) + ") k ON p.feature = k.feature")
def q_z5(spark, sf):
    """Drift of test rows against training rows: binned PSI and two-sample KS per feature."""
    v = T.vitals(spark, sf)
    return DR.compare_splits(v, F.col("split_bucket") < 70, F.col("split_bucket") >= 85, DRIFT_COLS,
                             {c: K.CLIP_RANGES[c] for c in DRIFT_COLS}).select("feature", "psi", "ks")


@query("z5_drift_deciles", W("vitals", extra=",\n".join(f"""c_{c} AS (SELECT {c} AS x, COUNT(*) FILTER (WHERE split_bucket < 70) AS r, COUNT(*) FILTER (WHERE split_bucket >= 85) AS n
  FROM vitals WHERE {c} IS NOT NULL AND (split_bucket < 70 OR split_bucket >= 85) GROUP BY 1),
b_{c} AS (SELECT LEAST(FLOOR((SUM(r) OVER (ORDER BY x) - r) * 10 / SUM(r) OVER ()), 9) AS bin, r / SUM(r) OVER () AS pr, n / SUM(n) OVER () AS pn FROM c_{c})"""
    for c in DRIFT_COLS)) + " UNION ALL ".join(f"""SELECT '{c}' AS feature, ROUND(SUM((pn - pr) * LN(pn / pr)), 6) AS psi_deciles FROM
  (SELECT GREATEST(SUM(pr), 1e-6) AS pr, GREATEST(SUM(pn), 1e-6) AS pn FROM b_{c} GROUP BY bin)""" for c in DRIFT_COLS))
def q_z5d(spark, sf):
    """PSI of test rows against training rows over the training rows' deciles."""
    v = T.vitals(spark, sf)
    return DR.compare_splits(v, F.col("split_bucket") < 70, F.col("split_bucket") >= 85, DRIFT_COLS,
                             {c: K.CLIP_RANGES[c] for c in DRIFT_COLS}).select("feature", "psi_deciles")


def _gate_sql():
    from .catalog_metrics import CURVE, LS
    return W("scored", extra=LS + ",\n" + CURVE + """,
auc AS (SELECT model, ROUND(SUM(pos * (neg_below + neg * 5e-1)) / (MAX(n_pos) * MAX(n_neg)), 6) AS roc_auc FROM cur GROUP BY model),
nw AS (SELECT CAST(COUNT(*) AS BIGINT) AS n FROM events WHERE ts > (SELECT MAX(ts) FROM events) - INTERVAL 7 DAY)""") + \
        """SELECT model, roc_auc, (SELECT n FROM nw) AS n_new_rows, (SELECT n FROM nw) > 1000 AND roc_auc > 93e-2 AS deploy,
  isodow((SELECT MAX(ts) FROM events)) = 1 AS retrain_day FROM auc"""


@query("z6_retrain_gate", _gate_sql())
def q_z6(spark, sf):
    """Z6 + H5s: weekly retrain gate (> 1000 new rows in the last 7 days and AUC > .93), Monday flag."""
    from .catalog_metrics import LONG
    auc = M.roc_auc(M.score_curve(LONG(spark, sf), ["model"]), ["model"])
    ev = T.table(spark, sf, "events")
    last = ev.agg(F.max("ts")).scalar()
    new = ev.filter(F.col("ts") > last - F.expr("INTERVAL 7 DAYS"))
    # H5s: the weekly job runs on Mondays (dayofweek: Sunday = 1, Monday = 2)
    return DR.retrain_gate(new, auc).withColumn("retrain_day", F.dayofweek(last) == 2)


@query("z7_grid_search")
def q_z7(spark, sf):
    """Cross-validation over the forests of the reference (trees, depth, leaf size); a patient's hours share a fold."""
    from ..operators import models as MD
    from . import train as TR
    data = TR.labelled_splits(spark, sf, "sepsis_label").filter(F.col("split") == "train")
    grid = [MD.RF_CONFIGS[name] for name in ("rf_compare", "rf_main")]
    return MD.grouped_grid_search(data, grid, K.F39, "sepsis_label", "patient_id")
