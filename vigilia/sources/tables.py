"""Readers for the shared tables and the fixture views built from them.

The driver's ``events`` table (one row = one patient-hour) is mapped to the
observation schema by integer formulas (FIXTURES.md §2), so the same rows come
out of Spark and of the SQL oracle. ``scored``, ``impacts`` and the prediction
log are derived from it; nothing is synthesized outside the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..operators import sequence as S

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(x):
    return F.lit(x).cast("double")


# Column formulas of the fixture view (FIXTURES.md §2); the SQL oracle uses the same text.
VITALS_COLUMNS = [
    "event_id AS obs_id",
    "user_id AS patient_id",
    "CAST(hour_from_admission AS BIGINT) AS hour_from_admission",
    "CAST(55 + (event_id*37+11)%61 AS DOUBLE) AS heart_rate",
    "CAST(10 + (event_id*41+3)%17 AS DOUBLE) AS respiratory_rate",
    "CAST(88 + (event_id*43+5)%13 AS DOUBLE) AS spo2_pct",
    "CASE WHEN event_id%37=0 THEN NULL ELSE 35.5e0 + ((event_id*53+7)%36)/1e1 END AS temperature_c",
    "CAST(80 + (event_id*59+2)%80 AS DOUBLE) AS systolic_bp",
    "CAST(50 + (event_id*61+9)%50 AS DOUBLE) AS diastolic_bp",
    "CASE event_id%6 WHEN 0 THEN 'none' WHEN 1 THEN 'nasal' WHEN 2 THEN 'mask' WHEN 3 THEN 'niv' WHEN 4 THEN 'hfnc' "
    "ELSE NULL END AS oxygen_device",
    "CASE WHEN event_id%6=0 THEN 0e0 ELSE CAST(event_id%7 AS DOUBLE) END AS oxygen_flow",
    "CAST(event_id%5 AS BIGINT) AS mobility_score",
    "CASE WHEN event_id%10=0 THEN 1 ELSE 0 END AS nurse_alert",
    "3e0 + ((event_id*67+1)%120)/1e1 AS wbc_count",
    "CASE WHEN event_id%29=0 THEN NULL ELSE ((event_id*71+4)%50)/1e1 END AS lactate",
    "5e-1 + ((event_id*79+6)%20)/1e1 AS creatinine",
    "((event_id*83+8)%400)/1e1 AS crp_level",
    "CASE WHEN event_id%31=0 THEN NULL ELSE 8e0 + ((event_id*89+3)%100)/1e1 END AS hemoglobin",
    "CAST(20 + (user_id*17)%70 AS BIGINT) AS age",
    "CASE WHEN user_id%2=0 THEN 'M' ELSE 'F' END AS gender",
    "CAST(user_id%8 AS BIGINT) AS comorbidity_index",
    "CASE user_id%3 WHEN 0 THEN 'ED' WHEN 1 THEN 'Elective' ELSE 'Transfer' END AS admission_type",
    "((event_id*101+13)%1000)*((event_id*211+7)%1000)/1e6 AS sepsis_risk_score",
    "CASE WHEN (event_id*97+5)%10=0 THEN 1 ELSE 0 END AS deterioration_next_12h",
    "((event_id*37+11)%1000)/1e3 AS score_a",
    "((event_id*73+29)%1000)/1e3 AS score_b",
    "CAST((event_id*48271+11)%10007%100 AS BIGINT) AS split_bucket",
]


def vitals_from_events(events: DataFrame, hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """The ``vitals`` view: observation columns computed from ``events`` ids.

    ``hour_from_admission`` is the 0-based position of the event within its
    user in (ts, event_id) order, computed skew-safe (hot users split by week).
    """
    e = events.select("event_id", "user_id", "ts")
    e = S.ordinal_within(e, "user_id", ["ts", "event_id"], "hour_from_admission",
                         chunk_basis=F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9),
                         hot_rows=hot_rows)
    return e.selectExpr(*VITALS_COLUMNS)


def vitals(spark: SparkSession, sf_dir: str, hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """Lazy ``vitals`` plan over the folder's files as they are now."""
    return vitals_from_events(table(spark, sf_dir, "events"), hot_rows=hot_rows)


def raw_lines(v: DataFrame) -> DataFrame:
    """Observation rows as a flat file would hold them: no patient id, an explicit ``line_no``
    in (patient_id, hour) order.

    The hour is the dense 0-based position inside the patient, so the line number
    is the patient's start offset (running sum of per-patient counts, a table of
    one row per patient, summed with the distributed prefix helper) + hour + 1.
    """
    from ..operators import prefix
    counts = v.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n"))
    starts = prefix.running_sums(counts, ["patient_id"], ["_n"]).select(
        "patient_id", (F.col("_n_cum") - F.col("_n")).alias("_start"))
    return (v.join(starts, on="patient_id")
            .withColumn("line_no", (F.col("_start") + F.col("hour_from_admission") + 1).cast("long"))
            .drop("_start", "patient_id"))


def scored(v: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """``scored`` view: two fixed model scores and the 6-hour label A as ``y``."""
    from ..operators import labels
    lab = labels.label_future_sepsis(C.with_sirs(v, keep_parts=False)) if label is None else label
    return lab.select("obs_id", "patient_id", F.col("hour_from_admission").alias("hour"),
                      "score_a", "score_b", F.col("sepsis_next_6h").alias("y"),
                      "sirs_score", "sirs_positive")


# Fixed per-feature impacts (stand-in for model attributions; SQL-checkable).
IMPACT_FEATURES = [
    "lactate", "wbc_count", "crp_level", "creatinine", "heart_rate", "respiratory_rate", "temperature_c",
    "systolic_bp", "diastolic_bp", "spo2_pct", "hemoglobin", "age", "oxygen_flow", "sirs_score",
]


def impacts(v: DataFrame) -> DataFrame:
    """Long table (obs_id, patient_id, feature, ord, value, impact); impact in [-0.1, 0.1]."""
    sv = C.with_sirs(v, keep_parts=False)
    stack = ", ".join(f"'{f}', {k}, CAST({f} AS DOUBLE)" for k, f in enumerate(IMPACT_FEATURES))
    long = sv.selectExpr("obs_id", "patient_id",
                         f"stack({len(IMPACT_FEATURES)}, {stack}) AS (feature, ord, value)")
    return long.withColumn(
        "impact",
        (((F.col("obs_id") * (F.col("ord") * 2 + 7) + F.col("ord") * 13 + 5) % 201) - 100) / F.lit(1e3),
    )


def prediction_log(v: DataFrame) -> DataFrame:
    """Prediction log rows (FIXTURES.md §1): one row per observation, model alternates by id."""
    from ..operators import decisions
    sv = C.with_sirs(v, keep_parts=False)
    model = F.when(F.col("obs_id") % 2 == 0, "xgboost").otherwise("random_forest")
    score = F.when(F.col("obs_id") % 2 == 0, F.col("score_b")).otherwise(F.col("score_a"))
    base = sv.select(
        "patient_id", "obs_id",
        F.timestamp_add("HOUR", F.col("hour_from_admission"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
         .alias("ts"),
        model.alias("model_used"), score.alias("risk_score"), "sirs_score", "sirs_positive",
    )
    return decisions.score_decision(base, "risk_score")


def impacts_wide(v: DataFrame) -> DataFrame:
    """``impacts`` in row form: obs_id, patient_id and an array of per-feature factors (row-local)."""
    from ..operators import explain
    sv = C.with_sirs(v, keep_parts=False)
    value = {f: F.col(f) for f in IMPACT_FEATURES}
    impact = {f: (((F.col("obs_id") * (2 * k + 7) + (13 * k + 5)) % 201) - 100) / F.lit(1e3)
              for k, f in enumerate(IMPACT_FEATURES)}
    return sv.select("obs_id", "patient_id", *IMPACT_FEATURES,
                     explain.factor_array(IMPACT_FEATURES, value, impact).alias("factors"))
