"""Queries: validation, quarantine, range lookups and per-row clinical rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import constants as K
from ..operators import features as FE
from ..operators import labels as L
from ..operators import quality as Q
from ..sources import tables as T
from .expected import CLIPS, RANGES
from . import expected as E
from .registry import query
from .sqlbase import with_views as W



def _req_view() -> str:
    return """req AS (
  SELECT obs_id, CAST(patient_id AS VARCHAR) AS patient_id, lactate, wbc_count, crp_level, creatinine, heart_rate,
    respiratory_rate, temperature_c AS temperature, spo2_pct AS spo2, systolic_bp, diastolic_bp, hemoglobin,
    CAST(hour_from_admission AS DOUBLE) AS hour_from_admission, oxygen_flow,
    CAST(mobility_score AS DOUBLE) AS mobility_score, nurse_alert, CAST(comorbidity_index AS DOUBLE) AS comorbidity_index,
    CAST(age AS INTEGER) AS age, gender,
    CASE WHEN admission_type = 'ED' THEN 'Emergency' ELSE admission_type END AS admission_type,
    oxygen_device, CAST(NULL AS VARCHAR) AS notes, score_a, score_b
  FROM vitals
)"""


def _sql_lit(v):
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return repr(v) + ("e0" if "e" not in repr(v) else "")
    return str(v)


def _checked_view() -> str:
    """SQL mirror of B9: defaults, then one CASE per rule in field order."""
    d = K.REQUEST_DEFAULTS
    cols = ("obs_id, patient_id, lactate, wbc_count, crp_level, creatinine, heart_rate, respiratory_rate, temperature, "
            "spo2, systolic_bp, diastolic_bp, hemoglobin, notes, score_a, score_b, "
            + ", ".join(f"COALESCE({f}, {_sql_lit(v)}) AS {f}" for f, v in d.items()))
    rules = [("patient_id IS NULL", "patient_id: field required")]
    rules += [(f"{f} IS NULL", f"{f}: field required") for f in Q.REQUIRED_DOUBLE]
    rules += [(f"{f} <= 0", f"{f}: must be > 0") for f in
              ["lactate", "wbc_count", "creatinine", "heart_rate", "respiratory_rate", "systolic_bp", "diastolic_bp",
               "hemoglobin"]]
    rules += [
        ("crp_level < 0", "crp_level: must be >= 0"),
        ("temperature < 30 OR temperature > 45", "temperature: must be between 30-45"),
        ("spo2 < 50 OR spo2 > 100", "spo2: must be between 50-100"),
        ("hour_from_admission < 0", "hour_from_admission: must be >= 0"),
        ("oxygen_flow < 0", "oxygen_flow: must be >= 0"),
        ("mobility_score < 0 OR mobility_score > 10", "mobility_score: must be between 0-10"),
        ("nurse_alert NOT IN (0, 1)", "nurse_alert: must be 0 or 1"),
        ("comorbidity_index < 0", "comorbidity_index: must be >= 0"),
        ("age < 0 OR age > 120", "age: must be between 0-120"),
    ]
    for f, allowed in K.REQUEST_ENUMS.items():
        rules.append((f"{f} NOT IN ({', '.join(_sql_lit(a) for a in allowed)})", f"{f}: not one of {','.join(allowed)}"))
    n = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in rules)
    t = ", ".join(f"CASE WHEN {c} THEN {_sql_lit(m)} END" for c, m in rules)
    return f"""chk0 AS (SELECT {cols} FROM req),
chk AS (SELECT *, {n} AS n_violations, concat_ws('; ', {t}) AS violations,
  ({n}) = 0 AS is_valid FROM chk0)"""


def CHECKED():
    return W("vitals", extra=_req_view() + ",\n" + _checked_view())


def _checked(spark, sf):
    return Q.validate_requests(Q.requests_from_vitals(T.vitals(spark, sf)))


@query("b9_validate_requests", CHECKED() + """SELECT obs_id, patient_id, is_valid, n_violations, violations,
  age, gender, admission_type, oxygen_device, mobility_score FROM chk""")
def q_b9(spark, sf):
    """Rule violations per request row, defaults for optional fields."""
    return _checked(spark, sf).select("obs_id", "patient_id", "is_valid", "n_violations", "violations",
                                      "age", "gender", "admission_type", "oxygen_device", "mobility_score")


@query("a8_batch_counts", CHECKED() + """SELECT patient_id, CAST(COUNT(*) AS BIGINT) AS total,
  CAST(SUM(CASE WHEN is_valid THEN 1 ELSE 0 END) AS BIGINT) AS successful FROM chk GROUP BY patient_id""")
def q_a8(spark, sf):
    """Per-batch (patient) total and successful counts; bad rows are kept out, not fatal."""
    return Q.batch_counts(_checked(spark, sf))


@query("c8_rejected_rows", CHECKED() + """SELECT r.obs_id, r.patient_id FROM req r
WHERE NOT EXISTS (SELECT 1 FROM chk c WHERE c.obs_id = r.obs_id AND c.is_valid)""")
def q_c8(spark, sf):
    """Rejected rows = input minus valid."""
    return Q.rejected_rows(_checked(spark, sf)).select("obs_id", "patient_id")


@query("a8_json_batches", CHECKED() + """SELECT patient_id, CAST(floor(hour_from_admission / 24) AS BIGINT) AS day, CAST(COUNT(*) AS BIGINT) AS total,
  CAST(SUM(CASE WHEN is_valid THEN 1 ELSE 0 END) AS BIGINT) AS successful,
  COALESCE(string_agg(CASE WHEN NOT is_valid THEN CAST(obs_id AS VARCHAR) || ': ' || violations END, ' | ' ORDER BY obs_id), '') AS errors
FROM chk GROUP BY 1, 2""")
def q_a8_json(spark, sf):
    """A8 + H8s: batch request bodies as JSON (a patient's day), parsed, checked and counted; errors listed per batch."""
    req = Q.requests_from_vitals(T.vitals(spark, sf)).withColumn("day", F.floor(F.col("hour_from_admission") / 24))
    raw = Q.json_batches(req, ["patient_id", "day"]).withColumnRenamed("patient_id", "batch_patient")
    checked = Q.validate_requests(Q.ingest_json(raw, ["batch_patient", "day"]))
    err = F.when(~F.col("is_valid"), F.struct("obs_id", F.concat(F.col("obs_id").cast("string"), F.lit(": "), F.col("violations")).alias("t")))
    out = checked.groupBy(F.col("batch_patient").alias("patient_id"), "day").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("is_valid").cast("long")).alias("successful"), F.sort_array(F.collect_list(err)).alias("e"))
    return out.withColumn("errors", F.array_join(F.transform("e", lambda x: x["t"]), " | ")).drop("e")


def _ranges_values() -> str:
    rows = []
    for p, lo, hi, u, _ in RANGES:
        rows.append(f"('{p}', {lo!r}e0, {hi!r}e0, '{u}')".replace(".0e0", ".0").replace("e0e0", "e0"))
    return "rng(parameter, low, high, unit) AS (VALUES " + ", ".join(rows) + ")"


def _long_sql() -> str:
    sel = "\n  UNION ALL ".join(f"SELECT obs_id, '{p}' AS parameter, CAST({p} AS DOUBLE) AS value FROM vitals"
                                for p in K.NORMAL_RANGES)
    return f"vl AS ({sel})"


@query("c1_range_lookup", W("vitals", extra=_ranges_values() + ",\n" + _long_sql()) + """SELECT v.obs_id, v.parameter,
  v.value, CAST(r.low AS DOUBLE) AS low, CAST(r.high AS DOUBLE) AS high, r.unit FROM vl v JOIN rng r ON v.parameter = r.parameter""")
def q_c1(spark, sf):
    """Observation x normal-range lookup, one row per (obs, parameter), broadcast join."""
    return Q.vitals_long(T.vitals(spark, sf)).select("obs_id", "parameter", "value", "low", "high", "unit")


def _validate_sql() -> str:
    abn = []
    crit = []
    for p, lo, hi, _u, _t in RANGES:
        a = K.API_NAME.get(p, p)
        cond = f"COALESCE({a} < {lo!r} OR {a} > {hi!r}, false)"
        abn.append((K.API_PARAMETERS.index(a), a, cond))
        crit.append(f"({cond} AND ({a} > {hi * 1.5!r} OR {a} < {lo * 0.5!r}))")
    abn.sort()
    n = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, _, c in abn)
    nc = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in crit)
    names = ", ".join(f"CASE WHEN {c} THEN '{a}' END" for _, a, c in abn)
    return f"""SELECT obs_id, {n} AS n_abnormal, {nc} AS n_critical, ({n}) = 0 AS is_valid,
  concat_ws(',', {names}) AS abnormal_parameters,
  CASE WHEN ({n}) >= 3 THEN 'Multiple abnormal values - Close monitoring recommended' END AS warning
FROM req"""


@query("c2_validate_ranges", W("vitals", extra=_req_view()) + _validate_sql())
def q_c2(spark, sf):
    """Abnormal count, critical count, validity, abnormal list and warning per observation."""
    return Q.validate_ranges(Q.requests_from_vitals(T.vitals(spark, sf)))


def _abn_long_sql() -> str:
    rows = []
    for p, lo, hi, _u, _t in RANGES:
        a = E.REQUEST_NAMES.get(p, p)
        rows.append(f"('{a}', {lo!r}, {hi!r}, '{E.REQUEST_RANGES[a]}')")
    rng = "arng(api_name, low, high, txt) AS (VALUES " + ", ".join(rows) + ")"
    sel = "\n  UNION ALL ".join(
        f"SELECT obs_id, '{K.API_NAME.get(p, p)}' AS api_name, CAST({K.API_NAME.get(p, p)} AS DOUBLE) AS value FROM req"
        for p in K.NORMAL_RANGES)
    return W("vitals", extra=_req_view() + f",\n{rng},\nrl AS ({sel})") + """SELECT rl.obs_id, rl.api_name AS parameter,
  rl.value, a.txt AS normal_range,
  CASE WHEN rl.value > a.high * 1.5e0 OR rl.value < a.low * 5e-1 THEN 'critical' ELSE 'warning' END AS severity
FROM rl JOIN arng a ON rl.api_name = a.api_name WHERE rl.value < a.low OR rl.value > a.high"""


@query("c2_abnormal_values", _abn_long_sql())
def q_c2_long(spark, sf):
    """C2 long form: abnormal values with range text and severity."""
    return Q.abnormal_long(Q.requests_from_vitals(T.vitals(spark, sf)))


@query("b4_wbc_flags", W("vitals") + """SELECT obs_id,
  CASE WHEN wbc_count > 12e0 THEN 1 ELSE 0 END AS sirs_wbc_high_flag,
  CASE WHEN wbc_count < 4e0 THEN 1 ELSE 0 END AS sirs_wbc_low_flag,
  CASE WHEN wbc_count > 12e0 OR wbc_count < 4e0 THEN 1 ELSE 0 END AS sirs_wbc_abnormal_flag FROM vitals""")
def q_b4(spark, sf):
    """Split WBC high / low flags and the combined abnormal flag."""
    v = T.vitals(spark, sf)
    return v.select("obs_id", C.sirs_wbc_high().alias("sirs_wbc_high_flag"), C.sirs_wbc_low().alias("sirs_wbc_low_flag"),
                    C.sirs_wbc().alias("sirs_wbc_abnormal_flag"))


@query("b6_label_sirs_organ", W("sv") + """SELECT obs_id,
  CASE WHEN COALESCE(lactate >= 2e0 OR crp_level >= 1e1 OR systolic_bp < 9e1 OR spo2_pct < 92e0, false) THEN 1 ELSE 0 END
    AS organ_dysfunction,
  CASE WHEN sirs_positive = 1 AND COALESCE(lactate >= 2e0 OR crp_level >= 1e1 OR systolic_bp < 9e1 OR spo2_pct < 92e0, false)
    THEN 1 ELSE 0 END AS sepsis_label FROM sv""")
def q_b6(spark, sf):
    """B6 / label C: organ-dysfunction predicate and SIRS-positive-with-dysfunction label."""
    return L.label_sirs_organ(T.vitals(spark, sf)).select("obs_id", "organ_dysfunction", "sepsis_label")


def _clip_sql() -> str:
    parts = []
    for c, (lo, hi) in CLIPS.items():
        parts.append(f"CASE WHEN {c} IS NULL THEN NULL ELSE GREATEST(LEAST({c}, {hi!r}), {lo!r}) END AS {c}")
    return W("vitals") + "SELECT obs_id, " + ", ".join(parts) + " FROM vitals"


@query("b7_clip_clinical", _clip_sql())
def q_b7(spark, sf):
    """Clinical clip of 11 columns, NULL kept."""
    v = FE.clip_clinical(T.vitals(spark, sf))
    return v.select("obs_id", *K.CLIP_RANGES)


@query("b8_coerce_numeric", W("vitals") + "SELECT obs_id, " + ", ".join(
    f"TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS {c}" for c in K.FLOAT_COLUMNS) + ", TRY_CAST(oxygen_device AS DOUBLE) AS oxygen_device FROM vitals")
def q_b8(spark, sf):
    """Numeric coercion of text columns (bad text -> NULL), absent columns skipped."""
    v = T.vitals(spark, sf)
    text = v.select("obs_id", *[F.col(c).cast("string").alias(c) for c in K.FLOAT_COLUMNS], "oxygen_device")
    return FE.coerce_numeric(text, K.FLOAT_COLUMNS + ["oxygen_device", "not_a_column"])


@query("b5_sepsis_now", W("vitals") + """SELECT obs_id, CASE WHEN sepsis_risk_score >= 7e-1 THEN 1 ELSE 0 END AS sepsis
FROM vitals""")
def q_b5(spark, sf):
    """Current sepsis flag (risk score >= 0.7)."""
    return T.vitals(spark, sf).select("obs_id", C.sepsis_now().alias("sepsis"))


@query("b3_sirs_criteria", W("vitals") + """SELECT obs_id, n AS sirs_score, n >= 2 AS sirs_positive, criteria_met,
  CASE WHEN n >= 2 THEN 'SIRS positive - Sepsis risk elevated' ELSE 'SIRS negative - Lower sepsis risk' END AS interpretation
FROM (SELECT obs_id, concat_ws(',',
    CASE WHEN temperature_c < 36e0 OR temperature_c > 38e0 THEN 'Temperature abnormal' END,
    CASE WHEN heart_rate > 90e0 THEN 'Heart rate > 90 bpm' END,
    CASE WHEN respiratory_rate > 20e0 THEN 'Respiratory rate > 20 /min' END,
    CASE WHEN wbc_count < 4e0 OR wbc_count > 12e0 THEN 'WBC abnormal' END) AS criteria_met,
  (CASE WHEN temperature_c < 36e0 OR temperature_c > 38e0 THEN 1 ELSE 0 END) + (CASE WHEN heart_rate > 90e0 THEN 1 ELSE 0 END)
  + (CASE WHEN respiratory_rate > 20e0 THEN 1 ELSE 0 END) + (CASE WHEN wbc_count < 4e0 OR wbc_count > 12e0 THEN 1 ELSE 0 END) AS n
  FROM vitals) t""")
def q_b3(spark, sf):
    """SIRS score with the names of the criteria met and the interpretation text."""
    v = T.vitals(spark, sf).withColumn("_c", C.sirs_criteria())
    n = F.size("_c")
    return v.select("obs_id", n.alias("sirs_score"), (n >= 2).alias("sirs_positive"),
                    F.array_join("_c", ",").alias("criteria_met"), C.sirs_interpretation(n >= 2).alias("interpretation"))


def _api_features_sql() -> str:
    m = {"temperature_c": "temperature", "spo2_pct": "spo2"}
    parts = []
    for f in K.F26:
        if f in ("sirs_score", "sirs_positive"):
            continue
        if f.startswith("oxygen_device_") or f.startswith("gender_") or f.startswith("admission_type_"):
            col, lvl = f.rsplit("_", 1)
            parts.append(f"CASE WHEN COALESCE({col}, {q_(K.REQUEST_DEFAULTS[col])}) = '{lvl}' THEN 1e0 ELSE 0e0 END AS {f}")
        else:
            src = m.get(f, f)
            parts.append(f"COALESCE(CAST({src} AS DOUBLE), 0e0) AS {f}")
    sirs = ("(CASE WHEN temperature > 38 OR temperature < 36 THEN 1 ELSE 0 END) + (CASE WHEN heart_rate > 90 THEN 1 ELSE 0 END)"
            " + (CASE WHEN respiratory_rate > 20 THEN 1 ELSE 0 END) + (CASE WHEN wbc_count > 12 OR wbc_count < 4 THEN 1 ELSE 0 END)")
    parts.append(f"CAST({sirs} AS DOUBLE) AS sirs_score")
    parts.append(f"CASE WHEN {sirs} >= 2 THEN 1e0 ELSE 0e0 END AS sirs_positive")
    for c in K.TREND_VITALS:
        src = m.get(c, c)
        parts.append(f"0e0 AS {c}_change")
        parts.append(f"COALESCE(CAST({src} AS DOUBLE), 0e0) AS {c}_rolling_mean")
    return W("vitals", extra=_req_view()) + "SELECT obs_id, " + ", ".join(parts) + " FROM req"


def q_(v):
    return "'" + str(v) + "'"


@query("b16_b17_request_features", _api_features_sql())
def q_b16(spark, sf):
    """B16 + B17: model features from request records: fixed order, alias map, absent/NULL -> 0,
    interface one-hot (baselines dropped), SIRS, and single-row trend defaults."""
    req = Q.requests_from_vitals(T.vitals(spark, sf))
    d = req.withColumns({c: F.coalesce(F.col(c), F.lit(K.REQUEST_DEFAULTS[c])) for c in ("oxygen_device", "gender",
                                                                                          "admission_type")})
    d = d.withColumns({f"{c}_{lv}": F.when(F.col(c) == lv, 1.0).otherwise(0.0)
                       for c, lvs in {"oxygen_device": ["mask", "nasal", "niv", "none"], "gender": ["M"],
                                      "admission_type": ["Elective", "Transfer"]}.items() for lv in lvs})
    s = C.sirs_score("temperature")
    d = d.withColumns({"sirs_score": s.cast("double"), "sirs_positive": C.sirs_positive(s).cast("double")})
    d = FE.single_row_defaults(d.withColumns({"temperature_c": F.col("temperature")}), K.TREND_VITALS)
    d = d.withColumns({f"{c}_rolling_mean": F.coalesce(F.col(f"{c}_rolling_mean"), F.lit(0.0)) for c in K.TREND_VITALS})
    feats = FE.assemble(d.drop("temperature_c"), [f for f in K.F26 if f not in ("sirs_score", "sirs_positive")])
    cols = [f for f in K.F26 if f not in ("sirs_score", "sirs_positive")] + ["sirs_score", "sirs_positive"] + \
        [f"{c}_{s_}" for c in K.TREND_VITALS for s_ in ("change", "rolling_mean")]
    return feats.select("obs_id", *cols)


@query("c4_scores_side_by_side", W("vitals") + """SELECT a.obs_id, a.score_a AS rf_score, b.score_b AS xgb_score,
  abs(a.score_a - b.score_b) AS score_gap FROM (SELECT obs_id, score_a FROM vitals) a JOIN (SELECT obs_id, score_b FROM vitals) b
  ON a.obs_id = b.obs_id""")
def q_c4(spark, sf):
    """C4 + C5: two models' score tables joined on the observation id (equi-join replaces positional zips)."""
    v = T.vitals(spark, sf)
    a = v.select("obs_id", F.col("score_a").alias("rf_score"))
    b = v.select("obs_id", F.col("score_b").alias("xgb_score"))
    return a.join(b, "obs_id").withColumn("score_gap", F.abs(F.col("rf_score") - F.col("xgb_score")))


@query("f5_head_by_id", W("vitals") + "SELECT obs_id, patient_id, hour_from_admission, heart_rate FROM vitals ORDER BY obs_id LIMIT 5")
def q_f5(spark, sf):
    """head of the table with an explicit order (the limit is the feature)."""
    return T.vitals(spark, sf).select("obs_id", "patient_id", "hour_from_admission", "heart_rate").orderBy("obs_id").limit(5)
