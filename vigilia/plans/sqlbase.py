"""SQL text of the fixture views, for the DuckDB oracle (same formulas as ``sources.tables``).

Each oracle query is ``WITH <views> SELECT ...``; views are composed by name so
every query only carries what it uses.
"""

from __future__ import annotations

VITALS = """vitals AS (
  SELECT event_id AS obs_id, user_id AS patient_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS hour_from_admission,
    CAST(55 + (event_id*37+11)%61 AS DOUBLE) AS heart_rate,
    CAST(10 + (event_id*41+3)%17 AS DOUBLE) AS respiratory_rate,
    CAST(88 + (event_id*43+5)%13 AS DOUBLE) AS spo2_pct,
    CASE WHEN event_id%37=0 THEN NULL ELSE 35.5e0 + ((event_id*53+7)%36)/1e1 END AS temperature_c,
    CAST(80 + (event_id*59+2)%80 AS DOUBLE) AS systolic_bp,
    CAST(50 + (event_id*61+9)%50 AS DOUBLE) AS diastolic_bp,
    CASE event_id%6 WHEN 0 THEN 'none' WHEN 1 THEN 'nasal' WHEN 2 THEN 'mask' WHEN 3 THEN 'niv' WHEN 4 THEN 'hfnc' ELSE NULL END AS oxygen_device,
    CASE WHEN event_id%6=0 THEN 0e0 ELSE CAST(event_id%7 AS DOUBLE) END AS oxygen_flow,
    CAST(event_id%5 AS BIGINT) AS mobility_score,
    CASE WHEN event_id%10=0 THEN 1 ELSE 0 END AS nurse_alert,
    3e0 + ((event_id*67+1)%120)/1e1 AS wbc_count,
    CASE WHEN event_id%29=0 THEN NULL ELSE ((event_id*71+4)%50)/1e1 END AS lactate,
    5e-1 + ((event_id*79+6)%20)/1e1 AS creatinine,
    ((event_id*83+8)%400)/1e1 AS crp_level,
    CASE WHEN event_id%31=0 THEN NULL ELSE 8e0 + ((event_id*89+3)%100)/1e1 END AS hemoglobin,
    CAST(20 + (user_id*17)%70 AS BIGINT) AS age,
    CASE WHEN user_id%2=0 THEN 'M' ELSE 'F' END AS gender,
    CAST(user_id%8 AS BIGINT) AS comorbidity_index,
    CASE user_id%3 WHEN 0 THEN 'ED' WHEN 1 THEN 'Elective' ELSE 'Transfer' END AS admission_type,
    ((event_id*101+13)%1000)*((event_id*211+7)%1000)/1e6 AS sepsis_risk_score,
    CASE WHEN (event_id*97+5)%10=0 THEN 1 ELSE 0 END AS deterioration_next_12h,
    ((event_id*37+11)%1000)/1e3 AS score_a,
    ((event_id*73+29)%1000)/1e3 AS score_b,
    CAST((event_id*48271+11)%10007%100 AS BIGINT) AS split_bucket
  FROM events
)"""

SIRS = """sv AS (
  SELECT *, sirs_temp + sirs_hr + sirs_rr + sirs_wbc AS sirs_score,
    CASE WHEN sirs_temp + sirs_hr + sirs_rr + sirs_wbc >= 2 THEN 1 ELSE 0 END AS sirs_positive
  FROM (SELECT *,
    CASE WHEN temperature_c > 38e0 OR temperature_c < 36e0 THEN 1 ELSE 0 END AS sirs_temp,
    CASE WHEN heart_rate > 90e0 THEN 1 ELSE 0 END AS sirs_hr,
    CASE WHEN respiratory_rate > 20e0 THEN 1 ELSE 0 END AS sirs_rr,
    CASE WHEN wbc_count > 12e0 OR wbc_count < 4e0 THEN 1 ELSE 0 END AS sirs_wbc
  FROM vitals) s0
)"""

LABELED = """lab AS (
  SELECT *, COALESCE(MAX(sepsis) OVER (PARTITION BY patient_id ORDER BY hour_from_admission
                                       RANGE BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) AS sepsis_next_6h
  FROM (SELECT *, CASE WHEN sepsis_risk_score >= 7e-1 THEN 1 ELSE 0 END AS sepsis FROM sv) l0
)"""

SCORED = """scored AS (
  SELECT obs_id, patient_id, hour_from_admission AS hour, score_a, score_b, sepsis_next_6h AS y, sirs_score,
    sirs_positive
  FROM lab
)"""

IMPACT_FEATURES = [
    "lactate", "wbc_count", "crp_level", "creatinine", "heart_rate", "respiratory_rate", "temperature_c",
    "systolic_bp", "diastolic_bp", "spo2_pct", "hemoglobin", "age", "oxygen_flow", "sirs_score",
]

IMPACTS = "impacts AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT obs_id, patient_id, '{f}' AS feature, {k} AS ord, CAST({f} AS DOUBLE) AS value, "
    f"(((obs_id*{2 * k + 7} + {13 * k + 5}) % 201) - 100)/1e3 AS impact FROM sv"
    for k, f in enumerate(IMPACT_FEATURES)) + "\n)"

# Prediction log: model alternates by obs_id parity; K4 tier; K3 confidence.
PLOG = """plog AS (
  SELECT patient_id, obs_id,
    TIMESTAMP '2024-01-01 00:00:00' + hour_from_admission * INTERVAL 1 HOUR AS ts,
    CASE WHEN obs_id % 2 = 0 THEN 'xgboost' ELSE 'random_forest' END AS model_used,
    CASE WHEN obs_id % 2 = 0 THEN score_b ELSE score_a END AS risk_score,
    sirs_score, sirs_positive
  FROM sv
), plog2 AS (
  SELECT *, CASE WHEN risk_score >= 85e-2 THEN 'CRITICAL' WHEN risk_score >= 7e-1 THEN 'HIGH'
                 WHEN risk_score >= 5e-1 THEN 'MODERATE' ELSE 'LOW' END AS risk_level,
    LEAST(95e-2, risk_score + 2e-1) AS confidence
  FROM plog
)"""

_VIEWS = {"vitals": VITALS, "sv": SIRS, "lab": LABELED, "scored": SCORED, "impacts": IMPACTS, "plog": PLOG}
_DEPS = {"vitals": [], "sv": ["vitals"], "lab": ["sv"], "scored": ["lab"], "impacts": ["sv"],
         "plog": ["sv"]}


def with_views(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named views and their dependencies, in order."""
    seen: list[str] = []

    def add(n):
        for d in _DEPS[n]:
            add(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        add(n)
    parts = [_VIEWS[n] for n in seen]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


def tier_sql(x: str, moderate: str = "5e-1", high: str = "7e-1", critical: str = "85e-2") -> str:
    return (f"CASE WHEN {x} >= {critical} THEN 'CRITICAL' WHEN {x} >= {high} THEN 'HIGH' "
            f"WHEN {x} >= {moderate} THEN 'MODERATE' ELSE 'LOW' END")


def rank_sql(level: str) -> str:
    return f"CASE {level} WHEN 'LOW' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 END"


def rec_sql(level: str, sirs_pos: str) -> str:
    from ..functions import constants as K
    base = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN '{v}'" for k, v in K.RECOMMENDATIONS.items()) + \
        " ELSE 'Monitor patient closely' END"
    return (f"({base} || CASE WHEN {sirs_pos} = 1 AND {level} IN ('HIGH', 'CRITICAL') "
            f"THEN '{K.RECOMMENDATION_SIRS_SUFFIX}' ELSE '' END)")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"
