"""Data quality: schema checks, request validation and quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dims


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """A3: fail before any job runs when required columns are absent (schema-only check)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"Missing required column(s): {', '.join(missing)}")
    return df


def detect_column(df: DataFrame, candidates: Sequence[str], requested: str | None = None) -> str | None:
    """A4: first candidate (after an explicit request) that exists in the schema."""
    for c in ([requested] if requested else []) + list(candidates):
        if c in df.columns:
            return c
    return None


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """B12."""
    return df.dropna(subset=[target])


def filter_class(df: DataFrame, target: str, value) -> DataFrame:
    """B13."""
    return df.filter(F.col(target) == value)


# ------------------------------------------------------------------ requests
REQUIRED_DOUBLE = ["lactate", "wbc_count", "crp_level", "creatinine", "heart_rate", "respiratory_rate",
                   "temperature", "spo2", "systolic_bp", "diastolic_bp", "hemoglobin"]


def requests_from_vitals(v: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Request records (the scoring interface's field names) built from observation rows."""
    return v.select(*extra,
        "obs_id",
        F.col("patient_id").cast("string").alias("patient_id"),
        "lactate", "wbc_count", "crp_level", "creatinine", "heart_rate", "respiratory_rate",
        F.col("temperature_c").alias("temperature"), F.col("spo2_pct").alias("spo2"),
        "systolic_bp", "diastolic_bp", "hemoglobin",
        F.col("hour_from_admission").cast("double").alias("hour_from_admission"),
        "oxygen_flow", F.col("mobility_score").cast("double").alias("mobility_score"), "nurse_alert",
        F.col("comorbidity_index").cast("double").alias("comorbidity_index"),
        F.col("age").cast("int").alias("age"), "gender",
        F.when(F.col("admission_type") == "ED", "Emergency").otherwise(F.col("admission_type")).alias("admission_type"),
        "oxygen_device", F.lit(None).cast("string").alias("notes"),
    )


def _rules() -> list[tuple[Column, str]]:
    c = F.col
    rules: list[tuple[Column, str]] = [(c("patient_id").isNull(), "patient_id: field required")]
    for f in REQUIRED_DOUBLE:
        rules.append((c(f).isNull(), f"{f}: field required"))
    for f in ["lactate", "wbc_count", "creatinine", "heart_rate", "respiratory_rate", "systolic_bp",
              "diastolic_bp", "hemoglobin"]:
        rules.append((c(f) <= 0, f"{f}: must be > 0"))
    rules += [
        (c("crp_level") < 0, "crp_level: must be >= 0"),
        ((c("temperature") < 30) | (c("temperature") > 45), "temperature: must be between 30-45"),
        ((c("spo2") < 50) | (c("spo2") > 100), "spo2: must be between 50-100"),
        (c("hour_from_admission") < 0, "hour_from_admission: must be >= 0"),
        (c("oxygen_flow") < 0, "oxygen_flow: must be >= 0"),
        ((c("mobility_score") < 0) | (c("mobility_score") > 10), "mobility_score: must be between 0-10"),
        (~c("nurse_alert").isin(0, 1), "nurse_alert: must be 0 or 1"),
        (c("comorbidity_index") < 0, "comorbidity_index: must be >= 0"),
        ((c("age") < 0) | (c("age") > 120), "age: must be between 0-120"),
    ]
    for f, allowed in K.REQUEST_ENUMS.items():
        rules.append((~c(f).isin(*allowed), f"{f}: not one of {','.join(allowed)}"))
    return rules


def validate_requests(req: DataFrame) -> DataFrame:
    """Violated rules per row (a row-local projection, no shuffle); defaults for optional fields.

    Adds ``n_violations``, ``violations`` (texts joined by '; ', in field order) and
    ``is_valid``; optional fields missing a value take the interface defaults.
    """
    rules = _rules()
    d = req.withColumns({f: F.coalesce(F.col(f), F.lit(v)) for f, v in K.REQUEST_DEFAULTS.items() if f in req.columns})
    n = sum((F.when(cond, 1).otherwise(0) for cond, _ in rules), F.lit(0))
    text = F.concat_ws("; ", *[F.when(cond, F.lit(msg)) for cond, msg in rules])
    return d.withColumns({"n_violations": n, "violations": text}).withColumn("is_valid", F.col("n_violations") == 0)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows (one pass each over the checked table)."""
    return checked.filter(F.col("is_valid")), checked.filter(~F.col("is_valid"))


REQUEST_FIELDS = (
    "obs_id long, patient_id string, lactate double, wbc_count double, crp_level double, creatinine double, heart_rate double, "
    "respiratory_rate double, temperature double, spo2 double, systolic_bp double, diastolic_bp double, hemoglobin double, "
    "hour_from_admission double, oxygen_flow double, mobility_score double, nurse_alert int, comorbidity_index double, age int, "
    "gender string, admission_type string, oxygen_device string, notes string")


def json_batches(req: DataFrame, batch: Sequence[str], model_name: str = "xgboost") -> DataFrame:
    """Batch request bodies as the interface takes them: ``{"patients": [...], "model_name": ...}`` per ``batch`` key.

    A batch has to be bounded by its key (a request body is one row)."""
    fields = [f.split()[0] for f in REQUEST_FIELDS.split(", ")]
    body = F.struct(F.sort_array(F.collect_list(F.struct(*fields))).alias("patients"), F.lit(model_name).alias("model_name"))
    return req.groupBy(*batch).agg(F.to_json(body).alias("body"))


def ingest_json(raw: DataFrame, batch: Sequence[str], body: str = "body") -> DataFrame:
    """A8 / H8s: one request row per patient of each JSON body (``from_json``, permissive). A body that does not parse
    gives one row with ``parse_error``; a patient that does not fit the fields is judged by the rules like any other."""
    schema = f"struct<patients: array<struct<{', '.join(f.replace(' ', ': ', 1) for f in REQUEST_FIELDS.split(', '))}>>, model_name: string>"
    d = raw.withColumn("_b", F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"}))
    d = d.select(*batch, F.col("_b.model_name").alias("model_name"), F.col("_b.patients").isNull().alias("parse_error"),
                 F.posexplode_outer("_b.patients").alias("position", "_p"))
    return d.select(*batch, "model_name", "parse_error", "position", "_p.*")


def rejected_rows(checked: DataFrame) -> DataFrame:
    """Rows that break a rule (the validity flag is on the row, so no join against the valid ones)."""
    return checked.filter(~F.col("is_valid"))


def batch_counts(checked: DataFrame, batch_key: str = "patient_id") -> DataFrame:
    """Per batch ``total`` and ``successful`` (bad rows never fail the batch)."""
    return checked.groupBy(batch_key).agg(F.count(F.lit(1)).alias("total"),
                                          F.sum(F.col("is_valid").cast("long")).alias("successful"))


# ------------------------------------------------------------------ ranges
def vitals_long(v: DataFrame, id_cols: Sequence[str] = ("obs_id",)) -> DataFrame:
    """One row per (observation, parameter) joined to the broadcast normal-range table."""
    params = list(K.NORMAL_RANGES)
    stack = ", ".join(f"'{p}', CAST(`{p}` AS DOUBLE)" for p in params)
    long = v.selectExpr(*id_cols, f"stack({len(params)}, {stack}) AS (parameter, value)")
    return long.join(dims.normal_ranges(v.sparkSession), on="parameter", how="inner")


def validate_ranges(req: DataFrame) -> DataFrame:
    """Abnormal parameters, severity and the multi-abnormal warning, row-local (no regroup shuffle).

    Abnormal: value < min or > max; critical when > 1.5 * max or < 0.5 * min.
    """
    abn, crit, names = [], [], []
    for p, (lo, hi, _u) in K.NORMAL_RANGES.items():
        a = K.API_NAME.get(p, p)
        x = F.col(a)
        is_abn = F.coalesce((x < lo) | (x > hi), F.lit(False))
        is_crit = is_abn & ((x > hi * 1.5) | (x < lo * 0.5))
        abn.append((K.API_PARAMETERS.index(a), a, is_abn))
        crit.append(is_crit)
    abn.sort(key=lambda t: t[0])
    n_abn = sum((F.when(e, 1).otherwise(0) for _, _, e in abn), F.lit(0))
    n_crit = sum((F.when(e, 1).otherwise(0) for e in crit), F.lit(0))
    return req.select(
        "obs_id",
        n_abn.alias("n_abnormal"),
        n_crit.alias("n_critical"),
        (n_abn == 0).alias("is_valid"),
        F.concat_ws(",", *[F.when(e, F.lit(a)) for _, a, e in abn]).alias("abnormal_parameters"),
        F.when(n_abn >= 3, F.lit("Multiple abnormal values - Close monitoring recommended")).alias("warning"),
    )


def abnormal_long(req: DataFrame) -> DataFrame:
    """C2 long form: one row per abnormal (observation, parameter) with range text and severity."""
    params = [K.API_NAME.get(p, p) for p in K.NORMAL_RANGES]
    stack = ", ".join(f"'{a}', CAST(`{a}` AS DOUBLE)" for a in params)
    long = req.selectExpr("obs_id", f"stack({len(params)}, {stack}) AS (api_name, value)")
    r = dims.normal_ranges(req.sparkSession).select("api_name", "low", "high", "api_range_text")
    j = long.join(r, on="api_name").filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
    sev = F.when((F.col("value") > F.col("high") * 1.5) | (F.col("value") < F.col("low") * 0.5), "critical") \
        .otherwise("warning")
    return j.select("obs_id", F.col("api_name").alias("parameter"), "value",
                    F.col("api_range_text").alias("normal_range"), sev.alias("severity"))
