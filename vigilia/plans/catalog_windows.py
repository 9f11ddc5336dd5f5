"""Queries: window operators (E1, E2, E4-E7, B12, B13, C3 join form) and the prepared feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import features as FE
from ..operators import labels as L
from ..operators import sequence as S
from ..operators import stays as ST
from ..session import scratch_path
from ..sources import io as IO
from ..sources import tables as T
from .registry import query
from .sqlbase import with_views as W

RAW_SQL = """raw AS (
  SELECT * EXCLUDE (patient_id), row_number() OVER (ORDER BY patient_id, hour_from_admission) AS line_no FROM vitals
), st AS (
  SELECT line_no, hour_from_admission,
    CASE WHEN lag(hour_from_admission) OVER (ORDER BY line_no) IS NULL
           OR hour_from_admission < lag(hour_from_admission) OVER (ORDER BY line_no) THEN 1 ELSE 0 END AS new_stay
  FROM raw
)"""


@query("e1_e2_rebuild_stays", W("vitals", extra=RAW_SQL) + """SELECT line_no, hour_from_admission, new_stay,
  CAST(SUM(new_stay) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS patient_id
FROM st""")
def q_e1e2(spark, sf):
    """E1 + E2: new-stay flag (first line or hour fell) and stay id = running count, keyless but distributed."""
    v = T.vitals(spark, sf)
    raw = T.raw_lines(v).select("line_no", "hour_from_admission")
    return ST.rebuild_stays(raw).select("line_no", "hour_from_admission", "new_stay", "patient_id")


@query("e1_e2_stay_count", W("vitals", extra=RAW_SQL) + """SELECT CAST(SUM(new_stay) AS BIGINT) AS n_stays,
  CAST(COUNT(*) AS BIGINT) AS n_lines FROM st""")
def q_e1e2_count(spark, sf):
    """E2 check: number of rebuilt stays (equals the number of patients of the fixture)."""
    v = T.vitals(spark, sf)
    raw = T.raw_lines(v).select("line_no", "hour_from_admission")
    st = ST.rebuild_stays(raw)
    return st.agg(F.sum("new_stay").cast("long").alias("n_stays"), F.count(F.lit(1)).alias("n_lines"))


@query("a1_csv_stays", W("vitals", extra=RAW_SQL) + """SELECT st.line_no, raw.heart_rate, raw.temperature_c, raw.gender,
  CAST(SUM(new_stay) OVER (ORDER BY st.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS patient_id
FROM st JOIN raw ON raw.line_no = st.line_no""")
def q_a1(spark, sf):
    """A1: observations written as several CSV files (NaN for missing readings), read back with line numbers, stays rebuilt."""
    raw = T.raw_lines(T.vitals(spark, sf))
    names = [f.split()[0] for f in IO.OBSERVATION_SCHEMA.split(", ")]
    path = scratch_path(spark, "csv")
    lines = raw.repartitionByRange(5, "line_no").sortWithinPartitions("line_no").select(*names)
    lines.write.option("header", True).option("nullValue", "NaN").csv(path)
    st = ST.rebuild_stays(IO.read_observations_csv(spark, path))
    return st.select("line_no", "heart_rate", "temperature_c", "gender", "patient_id")


@query("a1_csv_quarantine", W("vitals", extra=RAW_SQL) + """SELECT line_no, 'see note' AS heart_rate_text,
  CAST((SELECT COUNT(*) FROM raw WHERE line_no % 97 <> 0) AS BIGINT) AS n_readable FROM raw WHERE line_no % 97 = 0""")
def q_a1q(spark, sf):
    """A1: CSV files in which some lines hold text for a number: readable rows apart from malformed lines with their numbers."""
    raw = T.raw_lines(T.vitals(spark, sf))
    names = [f.split()[0] for f in IO.OBSERVATION_SCHEMA.split(", ")]
    path = scratch_path(spark, "csv")
    lines = raw.repartitionByRange(5, "line_no").sortWithinPartitions("line_no").withColumn(
        "heart_rate", F.when(F.col("line_no") % 97 == 0, "see note").otherwise(F.col("heart_rate").cast("string")))
    lines.select(*names).write.option("header", True).option("nullValue", "NaN").csv(path)
    good, bad = IO.read_with_quarantine(spark, path)
    return bad.select("line_no", F.get(F.split("line", ","), F.lit(names.index("heart_rate"))).alias("heart_rate_text"),
                      good.agg(F.count(F.lit(1))).scalar().alias("n_readable"))


LABEL_B = """lb AS (SELECT obs_id, LEAD(sirs_positive, 6) OVER (PARTITION BY patient_id ORDER BY hour_from_admission, obs_id)
  AS sirs_positive_6h FROM sv)"""


@query("e4_label_sirs_ahead", W("sv", extra=LABEL_B) + "SELECT obs_id, sirs_positive_6h FROM lb")
def q_e4(spark, sf):
    """E4 (label B): SIRS-positive flag six rows ahead within the patient; NULL for the last six."""
    return L.label_sirs_ahead(T.vitals(spark, sf)).select("obs_id", "sirs_positive_6h")


@query("b12_label_b_dropna", W("sv", extra=LABEL_B) + "SELECT obs_id, sirs_positive_6h FROM lb WHERE sirs_positive_6h IS NOT NULL")
def q_b12(spark, sf):
    """Rows with a NULL target dropped (label B)."""
    lb = L.label_sirs_ahead(T.vitals(spark, sf)).select("obs_id", "sirs_positive_6h")
    return lb.dropna(subset=["sirs_positive_6h"])


@query("e4_label_sirs_ahead_literal", W("sv") + """SELECT obs_id,
  LEAD(sirs_positive, 6) OVER (ORDER BY patient_id, hour_from_admission) AS sirs_positive_6h FROM sv""")
def q_e4_literal(spark, sf):
    """E4 literal form: six rows ahead over the whole table (crosses patients, like the notebook)."""
    return L.label_sirs_ahead(T.vitals(spark, sf), key=None).select("obs_id", "sirs_positive_6h")


@query("c3_label_interval_join", W("lab") + "SELECT obs_id, sepsis_next_6h FROM lab")
def q_c3(spark, sf):
    """Label A by the interval match written as an equi-join (second form of E3)."""
    return L.label_future_sepsis_join(T.vitals(spark, sf)).select("obs_id", "sepsis_next_6h")


@query("b13_positive_rows", W("lab") + "SELECT obs_id, patient_id FROM lab WHERE sepsis_next_6h = 1")
def q_b13(spark, sf):
    """Filter by class (label-A positives)."""
    return L.label_future_sepsis(T.vitals(spark, sf)).filter(F.col("sepsis_next_6h") == 1).select("obs_id", "patient_id")


def _trend_sql() -> str:
    parts = []
    for c in K.TREND_VITALS:
        parts.append(f"COALESCE({c} - LAG({c}) OVER w, 0e0) AS {c}_change")
        parts.append(f"ROUND(AVG({c}) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS {c}_rolling_mean")
    return W("vitals") + "SELECT obs_id, " + ", ".join(parts) + \
        " FROM vitals WINDOW w AS (PARTITION BY patient_id ORDER BY hour_from_admission, obs_id)"


@query("e5_e6_trend_features", _trend_sql())
def q_e5e6(spark, sf):
    """E5 + E6: change vs previous row (0 at start / missing) and trailing 3-row mean, five vitals."""
    d = FE.trend_features(T.vitals(spark, sf))
    cols = [F.col(f"{c}_change") for c in K.TREND_VITALS] + \
        [F.round(f"{c}_rolling_mean", 6).alias(f"{c}_rolling_mean") for c in K.TREND_VITALS]
    return d.select("obs_id", *cols)


@query("e7_last_12_readings", W("vitals") + """SELECT * FROM (SELECT obs_id, patient_id, hour_from_admission,
  row_number() OVER (PARTITION BY patient_id ORDER BY hour_from_admission DESC, obs_id DESC) AS rank FROM vitals) t
WHERE rank <= 12""")
def q_e7(spark, sf):
    """Last 12 hourly readings per patient (two-stage top-k, hot patients chunked)."""
    v = T.vitals(spark, sf).select("obs_id", "patient_id", "hour_from_admission")
    out = S.top_k_per_key(v, "patient_id", [F.col("hour_from_admission").desc(), F.col("obs_id").desc()], 12,
                          chunk_basis=F.col("hour_from_admission"))
    return out.withColumn("rank", F.col("rank").cast("long"))


def _prepared_sql() -> str:
    trend = []
    for c in K.TREND_VITALS:
        trend.append(f"COALESCE({c} - LAG({c}) OVER w, 0e0) AS {c}_change")
        trend.append(f"ROUND(AVG({c}) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS {c}_rolling_mean")
    onehot = [f"CASE WHEN {c} = '{lv}' THEN 1 ELSE 0 END AS {c}_{lv}"
              for c, lvs in K.CATEGORY_LEVELS.items() for lv in sorted(lvs)]
    base = [c for c in K.F17] + ["sirs_score", "sirs_positive", "sepsis_next_6h"]
    return W("lab") + "SELECT obs_id, " + ", ".join(base + trend + onehot) + \
        " FROM lab WINDOW w AS (PARTITION BY patient_id ORDER BY hour_from_admission, obs_id)"


@query("a5_prepared_table", _prepared_sql())
def q_prepared(spark, sf):
    """E-A prepare stage: label A, SIRS, trend features, one-hot, leakage columns dropped (F39 + target)."""
    from . import prepare as PR
    d = PR.prepared_table(T.vitals(spark, sf))
    return d.select("obs_id", *[F.round(c, 6).alias(c) if c.endswith("_rolling_mean") else F.col(c)
                                for c in K.F17 + ["sirs_score", "sirs_positive", "sepsis_next_6h"]
                                + [f"{v}_{s}" for v in K.TREND_VITALS for s in ("change", "rolling_mean")]
                                + [f"{c}_{lv}" for c, lvs in K.CATEGORY_LEVELS.items() for lv in sorted(lvs)]])
