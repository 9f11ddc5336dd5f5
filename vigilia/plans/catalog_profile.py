"""Queries: profiling aggregates and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import constants as K
from ..operators import labels as L
from ..operators import profile as P
from ..operators import split as SP
from ..session import scratch_path
from ..sources import io as IO
from ..sources import tables as T
from .registry import query
from .sqlbase import with_views as W

# Numeric columns of the vitals view, in schema order (the audit's feature list).
VITALS_NUMERIC = [
    "obs_id", "patient_id", "hour_from_admission", "heart_rate", "respiratory_rate", "spo2_pct", "temperature_c",
    "systolic_bp", "diastolic_bp", "oxygen_flow", "mobility_score", "nurse_alert", "wbc_count", "lactate",
    "creatinine", "crp_level", "hemoglobin", "age", "comorbidity_index", "sepsis_risk_score",
    "deterioration_next_12h", "score_a", "score_b", "split_bucket",
]
VITALS_ALL = [
    "obs_id", "patient_id", "hour_from_admission", "heart_rate", "respiratory_rate", "spo2_pct", "temperature_c",
    "systolic_bp", "diastolic_bp", "oxygen_device", "oxygen_flow", "mobility_score", "nurse_alert", "wbc_count",
    "lactate", "creatinine", "crp_level", "hemoglobin", "age", "gender", "comorbidity_index", "admission_type",
    "sepsis_risk_score", "deterioration_next_12h", "score_a", "score_b", "split_bucket",
]
AUDIT_TARGET = "deterioration_next_12h"
AUDIT_FEATURES = [c for c in VITALS_NUMERIC if c != AUDIT_TARGET]


def _lab(spark, sf):
    return L.label_future_sepsis(C.with_sirs(T.vitals(spark, sf), keep_parts=False))


@query("d1_shape", W("vitals") + f"SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST({len(VITALS_ALL)} AS BIGINT) AS n_cols FROM vitals")
def q_d1(spark, sf):
    """Rows x columns of the observation table."""
    return P.shape(T.vitals(spark, sf))


@query("d2_distinct_patients", W("vitals") + "SELECT CAST(COUNT(DISTINCT patient_id) AS BIGINT) AS n_distinct_patient_id FROM vitals")
def q_d2(spark, sf):
    """Distinct patients."""
    return P.distinct_count(T.vitals(spark, sf), "patient_id")


@query("d3_positives", W("lab") + """SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(sepsis_next_6h) AS BIGINT) AS n_positive,
  ROUND(AVG(sepsis_next_6h) * 100, 6) AS positive_pct FROM lab""")
def q_d3(spark, sf):
    """D3: label-A positives and rate in percent."""
    return P.positives(_lab(spark, sf), "sepsis_next_6h")


@query("d4_value_counts_sirs", W("sv") + """SELECT sirs_score, CAST(COUNT(*) AS BIGINT) AS n,
  ROUND(COUNT(*) * 1e2 / (SELECT COUNT(*) FROM sv WHERE sirs_score IS NOT NULL), 6) AS pct
FROM sv WHERE sirs_score IS NOT NULL GROUP BY sirs_score""")
def q_d4(spark, sf):
    """Value counts with percentages (SIRS score)."""
    return P.value_counts(C.with_sirs(T.vitals(spark, sf)), "sirs_score")


def _missing_sql():
    parts = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_count, "
        f"COUNT(*) AS n FROM vitals" for c in VITALS_ALL)
    return W("vitals", extra=f"m AS ({parts})") + """SELECT column_name, missing_count,
  ROUND(missing_count * 1e2 / n, 6) AS missing_pct FROM m WHERE missing_count > 0"""


@query("d5_missing_report", _missing_sql())
def q_d5(spark, sf):
    """Missing count and percent per column, only columns with missing values."""
    return P.missing_report(T.vitals(spark, sf))


@query("d6_patient_positives", W("lab") + """SELECT CAST(COUNT(DISTINCT patient_id) AS BIGINT) AS n_patients,
  CAST(COUNT(DISTINCT CASE WHEN sepsis_next_6h = 1 THEN patient_id END) AS BIGINT) AS n_positive_patients,
  CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(CASE WHEN sepsis_next_6h = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive_rows,
  ROUND(COUNT(DISTINCT CASE WHEN sepsis_next_6h = 1 THEN patient_id END) * 1e2 / COUNT(DISTINCT patient_id), 6) AS positive_patient_pct,
  ROUND(SUM(CASE WHEN sepsis_next_6h = 1 THEN 1 ELSE 0 END) * 1e2 / COUNT(*), 6) AS positive_row_pct FROM lab""")
def q_d6(spark, sf):
    """Unique positive patients, share of patients, share of rows."""
    return P.per_patient_positives(_lab(spark, sf), "patient_id", "sepsis_next_6h")


def _corr_sql():
    parts = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS feature, ROUND(corr(CAST({c} AS DOUBLE), CAST({AUDIT_TARGET} AS DOUBLE)), 6) AS corr FROM vitals"
        for c in AUDIT_FEATURES)
    return W("vitals") + parts


@query("f4_sorted_correlations", W("vitals", extra="c AS (" + _corr_sql()[len(W("vitals")):] + ")")
       + "SELECT feature, corr, CAST(row_number() OVER (ORDER BY corr DESC NULLS LAST, feature) AS INTEGER) AS rank FROM c")
def q_f4(spark, sf):
    """correlations with the target, highest first."""
    return P.sorted_correlations(P.target_correlations(T.vitals(spark, sf), AUDIT_TARGET, AUDIT_FEATURES))


@query("d7_target_correlations", _corr_sql())
def q_d7(spark, sf):
    """Pearson correlation of each numeric feature with the target."""
    return P.target_correlations(T.vitals(spark, sf), AUDIT_TARGET, AUDIT_FEATURES)


def _suit_sql():
    mm = ", ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in VITALS_ALL)
    mc = ", ".join(f"abs(corr(CAST({c} AS DOUBLE), CAST({AUDIT_TARGET} AS DOUBLE)))" for c in AUDIT_FEATURES)
    return W("vitals", extra=f"""w AS (SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
  CAST(COUNT(DISTINCT {AUDIT_TARGET}) AS BIGINT) AS n_classes, CAST(GREATEST({mm}) AS BIGINT) AS max_missing,
  GREATEST({mc}) AS max_abs_corr FROM vitals),
s AS (SELECT *, CAST({len(AUDIT_FEATURES)} AS BIGINT) AS n_features,
  (CASE WHEN n_rows > 5000 THEN 2 ELSE 0 END) + {2 if len(AUDIT_FEATURES) >= 10 else 0}
  + (CASE WHEN n_classes = 2 THEN 2 ELSE 0 END) + (CASE WHEN max_missing < n_rows * 25e-2 THEN 2 ELSE 0 END)
  + (CASE WHEN max_abs_corr > 1e-1 THEN 2 ELSE 0 END) AS score FROM w)""") + """SELECT n_rows, n_classes, max_missing,
  ROUND(max_abs_corr, 6) AS max_abs_corr, n_features, score,
  CASE WHEN score >= 8 THEN 'EXCELLENT DATASET FOR ML TRAINING' WHEN score >= 6 THEN 'GOOD DATASET WITH MINOR CLEANING NEEDED'
       ELSE 'DATASET NEEDS MAJOR IMPROVEMENTS' END AS verdict FROM s"""


@query("d8_suitability", _suit_sql())
def q_d8(spark, sf):
    """Dataset suitability score 0-10 and verdict."""
    return P.suitability(T.vitals(spark, sf), AUDIT_TARGET, AUDIT_FEATURES)


@query("d10_feature_means_train", W("vitals") + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(AVG({c}), 6) AS mean FROM vitals WHERE split_bucket < 70" for c in K.F17))
def q_d10(spark, sf):
    """Feature means of the training split."""
    return P.feature_means(T.vitals(spark, sf).filter(F.col("split_bucket") < 70), K.F17)


@query("d11_exact_medians_train", W("vitals") + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(quantile_cont({c}, 0.5), 6) AS median FROM vitals WHERE split_bucket < 70"
    for c in K.F17))
def q_d11(spark, sf):
    """Exact (interpolated) median per feature of the training split, distributed sort."""
    return P.exact_quantiles(T.vitals(spark, sf).filter(F.col("split_bucket") < 70), K.F17)


@query("d12_class_ratio", W("lab") + """SELECT CAST(SUM(CASE WHEN sepsis_next_6h = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
  CAST(SUM(CASE WHEN sepsis_next_6h = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
  ROUND(SUM(CASE WHEN sepsis_next_6h = 0 THEN 1 ELSE 0 END) / SUM(CASE WHEN sepsis_next_6h = 1 THEN 1 ELSE 0 END), 6)
    AS neg_pos_ratio FROM lab""")
def q_d12(spark, sf):
    """Class ratio negatives : positives."""
    return P.class_ratio(_lab(spark, sf), "sepsis_next_6h")


# ------------------------------------------------------------------ splits
_HASH_ORDER = ["_h", "obs_id"]


def _strat(spark, sf, cuts, names):
    d = _lab(spark, sf).withColumn("_h", SP.id_hash("obs_id"))
    return SP.stratified_split(d, "sepsis_next_6h", _HASH_ORDER, cuts_bp=cuts, names=names).drop("_h")


def _strat_sql(cuts, names):
    expr = " ".join(f"WHEN (r + 1) * 10000 <= n * {c} THEN '{nm}'" for c, nm in zip(cuts, names))
    return W("lab", extra="""rk AS (SELECT obs_id, sepsis_next_6h,
  row_number() OVER (PARTITION BY sepsis_next_6h ORDER BY (obs_id*48271+11)%10007, obs_id) - 1 AS r,
  COUNT(*) OVER (PARTITION BY sepsis_next_6h) AS n FROM lab)""") + \
        f"SELECT obs_id, sepsis_next_6h, CASE {expr} ELSE '{names[len(cuts)]}' END AS split FROM rk"


_SPLITS = {
    "i4_stratified_70_15_15": ((7000, 8500), ("train", "val", "test")),
    "i5_stratified_70_10_20": ((7000, 8000), ("train", "val", "test")),
    "i6_stratified_70_30": ((7000,), ("train", "test")),
    "i6_stratified_15_then_17_6": ((7004, 8500), ("train", "val", "test")),
}


def _register_split(name, cuts, names):
    @query(name, _strat_sql(cuts, names))
    def q(spark, sf):
        return _strat(spark, sf, cuts, names).select("obs_id", "sepsis_next_6h", "split")

    q.__doc__ = f"I4-I6: stratified split with exact per-class counts, cuts {cuts} (basis points)."
    return q


for _n, (_c, _nm) in _SPLITS.items():
    _register_split(_n, _c, _nm)


@query("f6_seeded_shuffle", W("vitals") + """SELECT obs_id,
  CAST(row_number() OVER (ORDER BY (obs_id*48271+11)%10007, obs_id) AS BIGINT) AS position FROM vitals""")
def q_f6(spark, sf):
    """seeded shuffle as a row position."""
    return SP.shuffle_order(T.vitals(spark, sf).select("obs_id"), "obs_id")


@query("a5_written_splits", _strat_sql(*_SPLITS["i4_stratified_70_15_15"]))
def q_a5_written(spark, sf):
    """A5: prepared table written with its split as a partition column and read back."""
    from . import prepare as PR
    path = scratch_path(spark, "splits")
    PR.write_splits(PR.prepared_table(T.vitals(spark, sf)), path)
    return spark.read.parquet(path).select("obs_id", "sepsis_next_6h", "split")


@query("a9_prediction_log", W("plog") + """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, CAST(COUNT(*) AS BIGINT) AS n_predictions,
  CAST(COUNT(DISTINCT patient_id) AS BIGINT) AS n_patients, ROUND(SUM(risk_score), 6) AS sum_score FROM plog2 GROUP BY 1""")
def q_a9(spark, sf):
    """Predictions appended in two batches to the log partitioned by day, then read back by day."""
    log, path = T.prediction_log(T.vitals(spark, sf)), scratch_path(spark, "prediction-log")
    for part in (0, 1):
        IO.append_predictions(log.filter(F.col("obs_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.countDistinct("patient_id").alias("n_patients"), F.round(F.sum("risk_score"), 6).alias("sum_score"))


@query("i9_patient_split", W("vitals") + """SELECT obs_id, patient_id,
  CASE WHEN ((patient_id*69621+7)%10009)%100 < 70 THEN 'train' WHEN ((patient_id*69621+7)%10009)%100 < 85 THEN 'val'
       ELSE 'test' END AS split FROM vitals""")
def q_i9(spark, sf):
    """Patient-grouped split (leak-free, all hours of a patient together)."""
    return SP.patient_split(T.vitals(spark, sf)).select("obs_id", "patient_id", "split")


@query("g3_split_check", _strat_sql(*_SPLITS["i4_stratified_70_15_15"]).replace(
    "SELECT obs_id, sepsis_next_6h, CASE", ", asg AS (SELECT obs_id, sepsis_next_6h, CASE", 1).replace(
    "END AS split FROM rk", "END AS split FROM rk)", 1) + """SELECT CAST(COUNT(*) AS BIGINT) AS n_assigned,
  CAST(SUM(CASE WHEN split='train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
  CAST(SUM(CASE WHEN split='val' THEN 1 ELSE 0 END) AS BIGINT) AS n_val,
  CAST(SUM(CASE WHEN split='test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test,
  CAST((SELECT COUNT(*) FROM (SELECT obs_id FROM asg GROUP BY obs_id HAVING COUNT(DISTINCT split) > 1) o) AS BIGINT) AS n_overlap,
  CAST((SELECT COUNT(*) FROM lab WHERE obs_id NOT IN (SELECT obs_id FROM asg)) AS BIGINT) AS n_missing FROM asg""")
def q_g3(spark, sf):
    """Split sizes, overlap (must be 0) and missing rows (must be 0)."""
    asg = _strat(spark, sf, *_SPLITS["i4_stratified_70_15_15"])
    return SP.check_split(asg, source=_lab(spark, sf))


@query("d14_split_distribution", _strat_sql(*_SPLITS["i4_stratified_70_15_15"]).replace(
    "SELECT obs_id, sepsis_next_6h, CASE", ", asg AS (SELECT obs_id, sepsis_next_6h, CASE", 1).replace(
    "END AS split FROM rk", "END AS split FROM rk)", 1) + """SELECT CASE WHEN GROUPING(split) = 1 THEN 'ALL' ELSE split END AS split,
  CASE WHEN GROUPING(sepsis_next_6h) = 1 THEN 'ALL' ELSE CAST(sepsis_next_6h AS VARCHAR) END AS sepsis_next_6h,
  CAST(COUNT(*) AS BIGINT) AS n_rows FROM asg GROUP BY ROLLUP (split, sepsis_next_6h)""")
def q_d14(spark, sf):
    """Rows per split and class with subtotals."""
    return P.split_distribution(_strat(spark, sf, *_SPLITS["i4_stratified_70_15_15"]), "split", "sepsis_next_6h")


@query("i7_upsample_minority", W("lab", extra="""tr AS (SELECT * FROM lab WHERE split_bucket < 70),
c AS (SELECT sepsis_next_6h AS y, COUNT(*) AS n FROM tr GROUP BY 1)""") + """SELECT y AS sepsis_next_6h,
  CAST((SELECT MAX(n) FROM c) AS BIGINT) AS n_rows, CAST(n AS BIGINT) AS n_distinct_obs FROM c""")
def q_i7(spark, sf):
    """I7 + G1: minority upsampled with replacement to the majority size (counts per class)."""
    tr = _lab(spark, sf).filter(F.col("split_bucket") < 70).withColumn("_h", SP.id_hash("obs_id"))
    up = SP.upsample_minority(tr, "sepsis_next_6h", _HASH_ORDER)
    return up.groupBy("sepsis_next_6h").agg(F.count(F.lit(1)).alias("n_rows"),
                                            F.countDistinct("obs_id").alias("n_distinct_obs"))


@query("i7_resample_minority", W("lab", extra="""tr AS (SELECT * FROM lab WHERE split_bucket < 70),
c AS (SELECT sepsis_next_6h AS y, COUNT(*) AS n FROM tr GROUP BY 1),
m AS (SELECT y, n, (SELECT MAX(n) FROM c) AS most FROM c WHERE y <> (SELECT y FROM c ORDER BY n DESC, y DESC LIMIT 1)),
num AS (SELECT obs_id, sepsis_next_6h, row_number() OVER (PARTITION BY sepsis_next_6h ORDER BY (obs_id * 48271 + 11) % 10007, obs_id) - 1 AS rn FROM tr),
d AS (SELECT y, ('0x' || substr(md5('42:' || j), 1, 15))::BIGINT % n AS rn FROM m, range((SELECT MAX(n) FROM c)) g(j))""") + """SELECT obs_id, sepsis_next_6h,
  CAST(COUNT(*) AS BIGINT) AS n_copies FROM d JOIN num ON num.sepsis_next_6h = d.y AND num.rn = d.rn GROUP BY 1, 2
UNION ALL SELECT obs_id, sepsis_next_6h, CAST(1 AS BIGINT) FROM tr WHERE sepsis_next_6h NOT IN (SELECT y FROM m)""")
def q_i7r(spark, sf):
    """I7 + G1: minority drawn with replacement up to the majority size (copies of each drawn row)."""
    tr = _lab(spark, sf).filter(F.col("split_bucket") < 70).withColumn("_h", SP.id_hash("obs_id"))
    up = SP.resample_minority(tr, "sepsis_next_6h", _HASH_ORDER)
    return up.groupBy("obs_id", "sepsis_next_6h").agg(F.count(F.lit(1)).alias("n_copies"))


D9_COLS = ["sepsis_risk_score", "lactate", "heart_rate", "score_a", "sirs_score"]


@query("d9_leakage_report", W("sv", extra="""d AS (SELECT *, CASE WHEN sepsis_risk_score >= 7e-1 THEN 1 ELSE 0 END AS y FROM sv),
r AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, ROUND(abs(corr({c}, y)), 6) AS abs_corr FROM d" for c in D9_COLS) + ")") + """SELECT feature,
  'name' AS reason, abs_corr FROM r WHERE feature = 'sepsis_risk_score' UNION ALL SELECT feature, 'correlation', abs_corr FROM r WHERE abs_corr >= 5e-1""")
def q_d9(spark, sf):
    """Columns that may leak the current sepsis flag, by name and by a correlation of .5 or more."""
    from ..functions import clinical as C
    v = C.with_sirs(T.vitals(spark, sf)).withColumn("y", C.sepsis_now())
    return P.leakage_report(v, "y", D9_COLS, cut=0.5)


@query("h5_timestamped_names", W("plog") + """SELECT patient_id, 'reports/sepsis_report_' || patient_id || '_' || strftime(MAX(ts), '%Y%m%d_%H%M%S') || '.pdf' AS report_name
FROM plog2 GROUP BY patient_id""")
def q_h5(spark, sf):
    """H5s: timestamped report names per patient (time of the last prediction)."""
    from ..operators import explain as X
    log = T.prediction_log(T.vitals(spark, sf)).groupBy("patient_id").agg(F.max("ts").alias("ts"))
    return log.select("patient_id", X.report_name(F.col("patient_id"), F.col("ts")).alias("report_name"))


@query("i8_class_weights", W("lab", extra="c AS (SELECT sepsis_next_6h, COUNT(*) AS n FROM lab GROUP BY 1)") + """SELECT
  sepsis_next_6h, CAST(n AS BIGINT) AS n, ROUND((SELECT SUM(n) FROM c) / ((SELECT COUNT(*) FROM c) * n), 6) AS weight FROM c""")
def q_i8(spark, sf):
    """I8: balanced class weights n / (k * n_c)."""
    return SP.class_weights(_lab(spark, sf), "sepsis_next_6h").withColumn("weight", F.round("weight", 6))


@query("i1_one_hot_all_levels", W("vitals") + "SELECT obs_id, " + ", ".join(
    f"CASE WHEN {c} = '{lv}' THEN 1 ELSE 0 END AS {c}_{lv}" for c, lvs in K.CATEGORY_LEVELS.items() for lv in sorted(lvs))
    + " FROM vitals")
def q_i1(spark, sf):
    """One-hot with all levels (sorted); missing category gives all zeros."""
    from ..operators import features as FE
    v = T.vitals(spark, sf).select("obs_id", *K.CATEGORY_LEVELS)
    return FE.one_hot(v)


@query("i2_one_hot_drop_first", W("vitals") + "SELECT obs_id, " + ", ".join(
    f"CASE WHEN {c} = '{lv}' THEN 1 ELSE 0 END AS {c}_{lv}" for c, lvs in K.CATEGORY_LEVELS.items()
    for lv in sorted(lvs)[1:]) + " FROM vitals")
def q_i2(spark, sf):
    """One-hot dropping the first sorted level."""
    from ..operators import features as FE
    v = T.vitals(spark, sf).select("obs_id", *K.CATEGORY_LEVELS)
    return FE.one_hot(v, drop_first=True)


@query("i3_median_impute", W("vitals", extra="""med AS (SELECT quantile_cont(temperature_c, 0.5) AS t,
  quantile_cont(lactate, 0.5) AS l, quantile_cont(hemoglobin, 0.5) AS h FROM vitals WHERE split_bucket < 70)""") + """SELECT
  obs_id, COALESCE(temperature_c, (SELECT t FROM med)) AS temperature_c, COALESCE(lactate, (SELECT l FROM med)) AS lactate,
  COALESCE(hemoglobin, (SELECT h FROM med)) AS hemoglobin FROM vitals""")
def q_i3(spark, sf):
    """Median imputation fitted on the training split, applied to all rows."""
    v = T.vitals(spark, sf)
    cols = ["temperature_c", "lactate", "hemoglobin"]
    med = P.exact_quantiles(v.filter(F.col("split_bucket") < 70), cols, rounded=False)
    fill = {c: med.filter(F.col("feature") == c).select("median").scalar() for c in cols}
    return v.select("obs_id", *[F.coalesce(F.col(c), fill[c]).alias(c) for c in cols])
