"""Per-row clinical rules on hand-built boundary rows."""

import math

from pyspark.sql import functions as F

from vigilia.functions import clinical as C
from vigilia.operators import decisions as D
from vigilia.operators import quality as Q


def rows(spark, schema, data):
    return spark.createDataFrame(data, schema)


def test_sirs_boundaries_and_nulls(spark):
    # temperature 36.0 / 38.0 are not abnormal (strict), 35.9 / 38.1 are; HR 90 vs 91; RR 20 vs 21; WBC 4/12 vs 3.9/12.1
    df = rows(spark, "t double, hr double, rr double, wbc double", [
        (36.0, 90.0, 20.0, 4.0), (38.0, 90.0, 20.0, 12.0), (35.9, 91.0, 21.0, 3.9), (38.1, 91.0, 21.0, 12.1),
        (None, None, None, None), (float("nan"), 95.0, 18.0, 8.5),
    ])
    df = C.nan_to_null(df)
    out = df.select(C.sirs_score("t", "hr", "rr", "wbc").alias("s")).collect()
    assert [r.s for r in out] == [0, 0, 4, 4, 0, 1]


def test_reference_cases_sirs(spark):
    # FIXTURES.md §1 worked cases: TEST001 -> 1, TEST002 -> 4, P001-routes -> 3, P001-client -> 4, explain case -> 2
    df = rows(spark, "t double, hr double, rr double, wbc double", [
        (37.0, 95.0, 18.0, 8.5), (39.5, 120.0, 30.0, 15.0), (38.5, 95.0, 22.0, 8.5), (38.5, 105.0, 24.0, 13.0),
        (38.0, 108.0, 16.0, 3.0)])
    assert [r.s for r in df.select(C.sirs_score("t", "hr", "rr", "wbc").alias("s")).collect()] == [1, 4, 3, 4, 2]


def test_risk_tiers_and_probes(spark):
    df = rows(spark, "p double", [(0.2,), (0.5,), (0.75,), (0.9,), (0.85,), (0.7,), (0.4999,)])
    got = [r.t for r in df.select(C.risk_tier("p").alias("t")).collect()]
    assert got == ["LOW", "MODERATE", "HIGH", "CRITICAL", "CRITICAL", "HIGH", "LOW"]


def test_report_tier_order_keeps_sirs4_low(spark):
    df = rows(spark, "p double, s int", [(0.2, 4), (0.9, 3), (0.9, 2), (0.2, 2), (0.2, 0)])
    got = [r.t for r in df.select(D.report_tier("p", "s").alias("t")).collect()]
    assert got == ["LOW RISK", "MODERATE RISK", "HIGH RISK - SEPSIS ALERT", "MILD RISK", "LOW RISK"]


def test_clip_keeps_null(spark):
    df = rows(spark, "x double", [(None,), (10.0,), (300.0,), (100.0,)])
    got = [r.x for r in df.select(C.clip("x", 30.0, 220.0).alias("x")).collect()]
    assert got == [None, 30.0, 220.0, 100.0]


def test_validation_negative_cases(spark):
    # reference negative tests: temperature 50, SpO2 150, missing patient id -> rejected; TEST001 valid
    base = dict(lactate=1.5, wbc_count=8.5, crp_level=5.0, creatinine=0.9, heart_rate=95.0, respiratory_rate=18.0,
                temperature=37.0, spo2=96.0, systolic_bp=120.0, diastolic_bp=80.0, hemoglobin=14.0)
    recs = [dict(base, obs_id=1, patient_id="TEST001"), dict(base, obs_id=2, patient_id="X", temperature=50.0),
            dict(base, obs_id=3, patient_id="Y", spo2=150.0), dict(base, obs_id=4, patient_id=None)]
    cols = ["obs_id", "patient_id"] + list(base)
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in recs],
                               "obs_id long, patient_id string, " + ", ".join(f"{c} double" for c in base))
    for c, t in [("hour_from_admission", "double"), ("oxygen_flow", "double"), ("mobility_score", "double"),
                 ("nurse_alert", "int"), ("comorbidity_index", "double"), ("age", "int"), ("gender", "string"),
                 ("admission_type", "string"), ("oxygen_device", "string")]:
        df = df.withColumn(c, F.lit(None).cast(t))
    out = {r.obs_id: r for r in Q.validate_requests(df).collect()}
    assert out[1].is_valid and out[1].violations == "" and out[1].age == 50 and out[1].admission_type == "Emergency"
    assert not out[2].is_valid and "temperature" in out[2].violations
    assert not out[3].is_valid and "spo2" in out[3].violations
    assert not out[4].is_valid and out[4].violations == "patient_id: field required"


def test_range_validation_counts_reference_cases(spark):
    # TEST001 -> 0 abnormal (valid); TEST002 -> 11 abnormal with warning (FIXTURES.md §1)
    cols = ["lactate", "wbc_count", "crp_level", "creatinine", "heart_rate", "respiratory_rate", "temperature", "spo2",
            "systolic_bp", "diastolic_bp", "hemoglobin"]
    t1 = (1.5, 8.5, 5.0, 0.9, 95.0, 18.0, 37.0, 96.0, 120.0, 80.0, 14.0)
    t2 = (5.0, 15.0, 50.0, 2.0, 120.0, 30.0, 39.5, 88.0, 160.0, 100.0, 10.0)
    df = spark.createDataFrame([(1,) + t1, (2,) + t2], "obs_id long, " + ", ".join(f"{c} double" for c in cols))
    out = {r.obs_id: r for r in Q.validate_ranges(df).collect()}
    assert out[1].n_abnormal == 0 and out[1].is_valid and out[1].warning is None
    assert out[2].n_abnormal == 11 and out[2].warning.startswith("Multiple abnormal")


def test_disagreement_and_routing_boundaries(spark):
    df = rows(spark, "obs_id long, score_a double, score_b double, sirs_positive int", [
        (1, 0.40, 0.45, 1), (2, 0.40, 0.55, 0), (3, 0.10, 0.90, 1), (4, 0.80, 0.55, 1), (5, 0.90, 0.60, 0)])
    a = {r.obs_id: r for r in D.disagreement_alert(df).collect()}
    assert a[1].alert_level == "NONE" and not a[1].flagged_for_review
    assert a[2].alert_level == "ADVISORY" and a[2].disagreement_type.startswith("Minor divergence — XGBoost")
    assert a[3].alert_level == "CRITICAL_REVIEW" and a[3].flagged_for_review
    assert a[4].alert_level == "WARNING" and "Random Forest (HIGH) vs XGBoost (MODERATE)" in a[4].disagreement_type
    # two tiers apart (CRITICAL vs MODERATE) escalates a WARNING-sized gap
    assert a[5].alert_level == "CRITICAL_REVIEW" and a[5].clinical_action.startswith("URGENT: Models disagree by 2+")
    r = {x.obs_id: x for x in D.smart_routing(df).collect()}
    assert r[3].routing_decision == "ENSEMBLE" and r[3].routing_reason.startswith("Models disagree")
    assert r[1].routing_reason.startswith("RF uncertain (confidence 20%, prob=0.400")
    assert math.isclose(r[3].final_probability, 0.58)
