"""Queries: explanations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import constants as K
from ..operators import explain as X
from ..operators import quality as Q
from ..sources import tables as T
from .expected import RANGES as X_RANGES
from .expected import SCRIPT_UNITS
from . import expected as E
from .registry import query
from .sqlbase import q, tier_sql
from .sqlbase import with_views as W


def _case(col: str, mapping: dict, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {q(v) if isinstance(v, str) else repr(v)}"
                              for k, v in mapping.items()) + f" ELSE {default} END"


LO = {p: lo for p, lo, _, _, _ in X_RANGES}
HI = {p: hi for p, _, hi, _, _ in X_RANGES}
UNIT = {p: u for p, _, _, u, _ in X_RANGES}
TEXT = {p: t for p, _, _, _, t in X_RANGES}


def _lo(c):
    return _case(c, LO)


def _hi(c):
    return _case(c, HI)


def _unit(c, script=False):
    return _case(c, UNIT | (SCRIPT_UNITS if script else {}))


def _txt(c):
    return _case(c, TEXT)


def _name(c, width=None):
    e = _case(c, K.FEATURE_NAMES, default=c)
    return f"substr({e}, 1, {width})" if width else e


VL = "vl AS (" + "\n  UNION ALL ".join(
    f"SELECT obs_id, '{p}' AS parameter, CAST({p} AS DOUBLE) AS value FROM vitals" for p in K.NORMAL_RANGES) + ")"


@query("b14_range_status", W("vitals", extra=VL) + f"""SELECT obs_id, parameter,
  CASE WHEN value < {_lo('parameter')} THEN 'LOW' WHEN value > {_hi('parameter')} THEN 'HIGH'
       WHEN value IS NOT NULL THEN 'normal' END AS status,
  printf('%.1f', value) || CASE WHEN value < {_lo('parameter')} OR value > {_hi('parameter')} THEN '*' ELSE '' END AS value_text,
  CASE WHEN value < {_lo('parameter')} THEN 'below normal (' || printf('%.1f', value) || ' ' || {_unit('parameter')} || ', normal: ' || {_txt('parameter')} || ')'
       WHEN value > {_hi('parameter')} THEN 'above normal (' || printf('%.1f', value) || ' ' || {_unit('parameter')} || ', normal: ' || {_txt('parameter')} || ')'
       WHEN value IS NOT NULL THEN 'normal (' || printf('%.1f', value) || ' ' || {_unit('parameter')} || ')' END AS status_text
FROM vl""")
def q_b14(spark, sf):
    """LOW / HIGH / normal per (obs, parameter) with '*' marker and status text."""
    long = Q.vitals_long(T.vitals(spark, sf)).select("obs_id", "parameter", "value")
    return X.range_status(long).select("obs_id", "parameter", "status", "value_text", "status_text")


@query("b15_range_position", W("vitals", extra=VL) + f"""SELECT obs_id, parameter,
  ROUND((value - ({_lo('parameter')} + {_hi('parameter')}) / 2) / (({_hi('parameter')} - {_lo('parameter')}) / 2) * 50 + 50, 6)
    AS position FROM vl WHERE parameter IN ({', '.join(q(p) for p in K.POSITION_FEATURES)})""")
def q_b15(spark, sf):
    """Position inside the normal range for the 8 key features (50 = centre)."""
    long = Q.vitals_long(T.vitals(spark, sf)).select("obs_id", "parameter", "value") \
        .filter(F.col("parameter").isin(*K.POSITION_FEATURES))
    return X.range_position(long).select("obs_id", "parameter", F.round("position", 6).alias("position"))


@query("c7_display_names", W("impacts") + f"SELECT obs_id, feature, {_name('feature')} AS display_name FROM impacts")
def q_c7(spark, sf):
    """Feature -> display name, default the raw name."""
    long = T.impacts(T.vitals(spark, sf))
    return long.select("obs_id", "feature", X.display_name(F.col("feature")).alias("display_name"))


RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY abs(impact) DESC, ord) AS rank FROM impacts)"


@query("e9_rank_by_impact", W("impacts", extra=RANKED) + "SELECT obs_id, CAST(rank AS INTEGER) AS rank, feature FROM rk")
def q_e9(spark, sf):
    """Rank of features by |impact| inside each observation (row-local sort)."""
    return X.ranked_long(T.impacts_wide(T.vitals(spark, sf)), "factors").select("obs_id", "rank", "feature")


@query("f2_top10_factors", W("impacts", extra=RANKED) + """SELECT obs_id, CAST(rank AS INTEGER) AS rank, feature, impact
FROM rk WHERE rank <= 10""")
def q_f2(spark, sf):
    """top-10 factors per observation."""
    return X.ranked_long(T.impacts_wide(T.vitals(spark, sf)), "factors", k=10).select("obs_id", "rank", "feature", "impact")


@query("m6_impact_table", W("impacts", extra=RANKED) + f"""SELECT obs_id, CAST(rank AS INTEGER) AS rank, feature,
  {_name('feature', 28)} AS display_name,
  CASE WHEN feature IN ({', '.join(q(p) for p in K.NORMAL_RANGES)})
       THEN printf('%.1f', value) || CASE WHEN value < {_lo('feature')} OR value > {_hi('feature')} THEN '*' ELSE '' END
       ELSE printf('%.2f', value) END AS value_text,
  printf('%+.4f', impact) AS impact_text,
  CASE WHEN impact > 0 THEN '^ Risk' WHEN impact < 0 THEN 'v Risk' ELSE '-' END AS direction
FROM rk WHERE rank <= 10""")
def q_m6(spark, sf):
    """M6: top-10 impact table with display names, value text (* outside range), signed impact, direction."""
    return X.impact_rows(T.impacts_wide(T.vitals(spark, sf)), "factors", 10)


_REPORT_COLS = f"""{_name('feature', 35)} AS display_name,
  CASE WHEN {_lo('feature')} IS NOT NULL
       THEN printf('%.1f', value) || CASE WHEN value < {_lo('feature')} OR value > {_hi('feature')} THEN '* ' ELSE ' ' END || {_unit('feature')}
       ELSE printf('%.2f', value) END AS value_text,
  printf('%.4f', abs(impact)) AS impact_text,
  CASE WHEN impact > 0 THEN 'Increases' WHEN impact < 0 THEN 'Decreases' ELSE 'Neutral' END AS direction"""


@query("m6_report_table", W("impacts", extra=RANKED) + f"""SELECT obs_id, CAST(rank AS INTEGER) AS rank, feature, {_REPORT_COLS}
FROM rk WHERE rank <= 10""")
def q_m6_report(spark, sf):
    """M6, report form: value with unit, |impact|, Increases / Decreases / Neutral."""
    return X.impact_rows(T.impacts_wide(T.vitals(spark, sf)), "factors", 10, report=True)


@query("m10_report_factors", W("impacts", extra=RANKED + """,
lt AS (SELECT obs_id, patient_id FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY hour_from_admission DESC, obs_id DESC) AS rn
  FROM vitals) x WHERE rn = 1)""") + f"""SELECT lt.patient_id, rk.obs_id, CAST(rank AS INTEGER) AS rank, feature, {_REPORT_COLS}
FROM rk JOIN lt ON rk.obs_id = lt.obs_id WHERE rank <= 10""")
def q_m10_factors(spark, sf):
    """Factor table of each patient's report (top 10 of the latest observation)."""
    v = T.vitals(spark, sf)
    latest = X.latest_as_of(v, None, cols=["obs_id"]).select("obs_id")
    w = T.impacts_wide(v).join(latest, "obs_id", "left_semi")
    return X.impact_rows(w, "factors", 10, keep=("patient_id", "obs_id"), report=True)


@query("m3_bedside_text", W("sv") + """SELECT obs_id, CASE
  WHEN score_a >= 5e-1 THEN 'The computer analysis shows a HIGH chance of developing a serious' || chr(10)
    || 'infection (sepsis) in the next 6 hours. Immediate medical attention' || chr(10) || 'is recommended.'
  WHEN score_a >= 3e-1 OR sirs_score >= 2 THEN 'The computer analysis shows a MODERATE chance of developing a serious' || chr(10)
    || 'infection (sepsis). The medical team will monitor closely and may' || chr(10) || 'order additional tests.'
  ELSE 'The computer analysis shows a LOW chance of developing a serious' || chr(10)
    || 'infection (sepsis). Continue normal monitoring.' END AS bedside_text FROM sv""")
def q_m3_bedside(spark, sf):
    """M3, bedside form: paragraph for patients and families."""
    v = C.with_sirs(T.vitals(spark, sf), keep_parts=False)
    return v.select("obs_id", X.bedside_patient_text(F.col("score_a"), F.col("sirs_score")).alias("bedside_text"))


def _factor_sql(variant: str) -> str:
    script = variant == "script"
    inr = f"feature IN ({', '.join(q(p) for p in K.NORMAL_RANGES)})"
    v1 = "printf('%.1f', value)"
    below = f"'below normal (' || {v1} || ' ' || {_unit('feature', script)} || ', normal: ' || {_txt('feature')} || ')'"
    above = f"'above normal (' || {v1} || ' ' || {_unit('feature', script)} || ', normal: ' || {_txt('feature')} || ')'"
    normal = f"'normal (' || {v1} || ' ' || {_unit('feature', script)} || ')'"
    plain = f"'value: ' || {v1}"
    if script:
        rstat = f"CASE WHEN {inr} AND value < {_lo('feature')} THEN {below} WHEN {inr} AND value > {_hi('feature')} THEN {above} WHEN {inr} THEN {normal} ELSE {plain} END"
        pstat = rstat
    else:
        rstat = f"CASE WHEN {inr} AND value < {_lo('feature')} THEN {below} WHEN {inr} AND value > {_hi('feature')} THEN {above} ELSE {plain} END"
        pstat = f"CASE WHEN {inr} AND value >= {_lo('feature')} AND value <= {_hi('feature')} THEN {normal} ELSE {plain} END"
    k = 8 if script else 10
    extra = " AND abs(impact) > 5e-2" if script else ""
    return W("impacts", extra=RANKED + f""",
tp AS (SELECT * FROM rk WHERE rank <= {k}{extra}),
r AS (SELECT obs_id, {_name('feature')} || ': ' || {rstat} AS t,
        row_number() OVER (PARTITION BY obs_id ORDER BY rank) AS n FROM tp WHERE impact > 2e-2),
p AS (SELECT obs_id, {_name('feature')} || ': ' || {pstat} AS t,
        row_number() OVER (PARTITION BY obs_id ORDER BY rank) AS n FROM tp WHERE impact < -2e-2),
ra AS (SELECT obs_id, string_agg(t, ' | ' ORDER BY n) AS s FROM r WHERE n <= 5 GROUP BY obs_id),
pa AS (SELECT obs_id, string_agg(t, ' | ' ORDER BY n) AS s FROM p WHERE n <= 3 GROUP BY obs_id),
ids AS (SELECT DISTINCT obs_id FROM impacts)""") + """SELECT ids.obs_id, COALESCE(ra.s, '') AS risk_factors,
  COALESCE(pa.s, '') AS protective_factors FROM ids LEFT JOIN ra ON ids.obs_id = ra.obs_id LEFT JOIN pa ON ids.obs_id = pa.obs_id"""


@query("m7_f3_risk_protective", _factor_sql("bedside"))
def q_m7(spark, sf):
    """M7 + F3: top-5 risk and top-3 protective factors (|impact| > .02 of the top 10) with status text."""
    w = T.impacts_wide(T.vitals(spark, sf))
    r, p = X.risk_protective(F.col("factors"), "bedside")
    return w.select("obs_id", r.alias("risk_factors"), p.alias("protective_factors"))


@query("m7_script_factors", _factor_sql("script"))
def q_m7s(spark, sf):
    """M7 (script variant): top 8, |impact| > .05, normal values reported as normal."""
    w = T.impacts_wide(T.vitals(spark, sf))
    r, p = X.risk_protective(F.col("factors"), "script")
    return w.select("obs_id", r.alias("risk_factors"), p.alias("protective_factors"))


def _req_sql():
    from .catalog_quality import _req_view
    return W("vitals", extra=_req_view())


def _imp_sql():
    parts = []
    for p, lo, hi, _u, _t in E.RANGES:
        a = E.REQUEST_NAMES.get(p, p)
        mid = (lo + hi) / 2
        parts.append(f"SELECT obs_id, {E.REQUEST_ORDER.index(a)} AS ord, '{a}' AS feature, {a} AS value, "
                     f"CASE WHEN {a} IS NOT NULL THEN LEAST(abs({a} - {mid!r}) / {mid!r}, 5e-1) END AS imp FROM req")
    return "imp AS (" + " UNION ALL ".join(parts) + "), irk AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY imp DESC, ord) AS rank FROM imp WHERE imp IS NOT NULL)"


@query("m1_deviation_importance", _req_sql().rstrip("\n") + ",\n" + _imp_sql() + """
SELECT obs_id, CAST(rank AS INTEGER) AS rank, feature, ROUND(imp, 6) AS importance FROM irk WHERE rank <= 5""")
def q_m1(spark, sf):
    """M1: deviation importance min(|v - mid| / mid, .5), top 5 per request (the interface's 'explain')."""
    req = Q.requests_from_vitals(T.vitals(spark, sf))
    top = X.deviation_importance(req, 5)
    return req.select("obs_id", F.posexplode(top).alias("pos", "f")).select(
        "obs_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.feature").alias("feature"),
        F.round("f.impact", 6).alias("importance"))


def _doctor_sql():
    unit = _case("feature", K.API_UNIT, default="''")
    line = f"'\n- ' || feature || ': ' || CAST(value AS VARCHAR) || ' ' || {unit} || ' (Impact: ' || printf('%.1f', imp * 1e2) || '%)'"
    interp = (f"CASE WHEN p > 7e-1 THEN {q(chr(10) + K.DOCTOR_HIGH)} WHEN p > 5e-1 THEN {q(chr(10) + K.DOCTOR_MODERATE)} "
              f"ELSE {q(chr(10) + K.DOCTOR_LOW)} END")
    return _req_sql().rstrip("\n") + ",\n" + _imp_sql() + f""",
ln AS (SELECT obs_id, string_agg({line}, '' ORDER BY rank) AS lines FROM irk WHERE rank <= 3 GROUP BY obs_id)
SELECT r.obs_id, {q(K.DOCTOR_HEADER)} || printf('%.1f', r.score_b * 1e2) || '%' || '\n\nKey Clinical Parameters:\n'
  || COALESCE(ln.lines, '') || '\n\nClinical Interpretation:' || {interp.replace('p >', 'r.score_b >')} AS doctor_text
FROM req r LEFT JOIN ln ON r.obs_id = ln.obs_id"""


@query("m2_doctor_text", _doctor_sql())
def q_m2(spark, sf):
    """M2: clinician text (score, top 3 parameters with value, unit and impact, interpretation)."""
    req = Q.requests_from_vitals(T.vitals(spark, sf), extra=["score_b"])
    req = req.withColumn("_top", X.deviation_importance(req, 3))
    return req.select("obs_id", X.doctor_text(F.col("score_b"), F.col("_top")).alias("doctor_text"))


def _patient_sql():
    para = _case("lvl", K.PATIENT_TEXT)
    return W("vitals") + f"""SELECT obs_id, lvl AS risk_level, {q(K.PATIENT_HEADER)} || lvl || '\nRisk Score: '
  || printf('%.0f', score_b * 1e2) || '%' || '\n\nWhat does this mean?\n' || '\n' || {para} || '\n' || {q(K.PATIENT_FOOTER)}
  AS patient_text FROM (SELECT obs_id, score_b, {tier_sql('score_b')} AS lvl FROM vitals) t"""


@query("m3_patient_text", _patient_sql())
def q_m3(spark, sf):
    """M3: patient text by tier."""
    v = T.vitals(spark, sf).withColumn("risk_level", C.risk_tier("score_b"))
    return v.select("obs_id", "risk_level", X.patient_text(F.col("score_b"), F.col("risk_level")).alias("patient_text"))


def _kp_sql():
    t = K.KEY_POINT_TEXT
    return W("sv") + f"""SELECT obs_id, concat_ws(' | ',
  CASE WHEN lactate > 2e0 THEN {q(t[0])} END, CASE WHEN wbc_count > 12 OR wbc_count < 4 THEN {q(t[1])} END,
  CASE WHEN crp_level > 10 THEN {q(t[2])} END, CASE WHEN temperature_c > 38 OR temperature_c < 36 THEN {q(t[3])} END,
  CASE WHEN heart_rate > 100 THEN {q(t[4])} END,
  CASE WHEN sirs_score >= 2 THEN 'SIRS criteria met (' || CAST(sirs_score AS VARCHAR) || '/4): body shows signs of stress' END)
  AS key_points FROM sv"""


@query("m8_key_points", _kp_sql())
def q_m8(spark, sf):
    """M8: ordered key-point rules (bedside explanation)."""
    sv = C.with_sirs(T.vitals(spark, sf), keep_parts=False)
    return sv.select("obs_id", F.array_join(X.key_points(), " | ").alias("key_points"))


def _actions_sql():
    arr = lambda xs: q(" | ".join(xs))
    return W("sv") + f"""SELECT obs_id, CASE WHEN score_a >= 5e-1 THEN {arr(K.ACTIONS_HIGH)}
  WHEN score_a >= 3e-1 OR sirs_score >= 2 THEN {arr(K.ACTIONS_MODERATE)} ELSE {arr(K.ACTIONS_LOW)} END AS actions FROM sv"""


@query("m9_actions", _actions_sql())
def q_m9(spark, sf):
    """M9: action list by decision / p >= .30 or SIRS >= 2 / else."""
    sv = C.with_sirs(T.vitals(spark, sf), keep_parts=False)
    return sv.select("obs_id", F.array_join(X.actions("score_a", "sirs_score"), " | ").alias("actions"))


@query("c6_asof_latest_48h", W("vitals") + """SELECT patient_id, obs_id, hour_from_admission, heart_rate, lactate FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY hour_from_admission DESC, obs_id DESC) AS rn
  FROM vitals WHERE hour_from_admission <= 48) t WHERE rn = 1""")
def q_c6(spark, sf):
    """Latest reading at or before hour 48 per patient (as-of via max_by, partial aggregation)."""
    v = T.vitals(spark, sf)
    return X.latest_as_of(v, 48, cols=["obs_id", "hour_from_admission", "heart_rate", "lactate"])


def _report_sql():
    R = K.REPORT_FINDINGS
    d = K.REPORT_DEFAULTS
    f = {c: f"COALESCE({c}, {d[c]!r})" for c in X.READING_FIELDS}

    def t(key, v):
        pre, dd, suf = R[key]
        val = f"printf('%.{dd}f', {v})" if dd is not None else f"CAST({v} AS VARCHAR)"
        return f"{q(pre)} || {val} || {q(suf)}"
    findings = (f"concat_ws(' | ', CASE WHEN lac > 2e0 THEN {t('lactate_high', 'lac')} END, "
                f"CASE WHEN wbc > 12 THEN {t('wbc_high', 'wbc')} WHEN wbc < 4 THEN {t('wbc_low', 'wbc')} END, "
                f"CASE WHEN crp > 10 THEN {t('crp_high', 'crp')} END, "
                f"CASE WHEN tmp > 38 THEN {t('fever', 'tmp')} WHEN tmp < 36 THEN {t('hypothermia', 'tmp')} END, "
                f"CASE WHEN hr > 100 THEN {t('tachycardia', 'hr')} END, "
                f"CASE WHEN s >= 2 THEN {t('sirs', 's')} END)")
    arr = lambda xs: q(" | ".join(xs))
    return W("vitals") + f"""SELECT patient_id, latest_obs_id, latest_hour, probability, s AS sirs_score,
  CASE WHEN s = 3 THEN 'MODERATE RISK' WHEN probability >= 5e-1 THEN 'HIGH RISK - SEPSIS ALERT' WHEN s = 2 THEN 'MILD RISK'
       ELSE 'LOW RISK' END AS report_tier, n_readings, reading_hours,
  CASE WHEN {findings} = '' THEN {q(K.NO_FINDINGS)} ELSE {findings} END AS findings,
  CASE WHEN probability >= 5e-1 THEN {arr(K.ACTIONS_HIGH)} WHEN probability >= 3e-1 OR s >= 2 THEN {arr(K.ACTIONS_MODERATE)}
       ELSE {arr(K.ACTIONS_LOW)} END AS actions
FROM (SELECT *, (CASE WHEN tmp > 38e0 OR tmp < 36e0 THEN 1 ELSE 0 END) + (CASE WHEN hr > 90e0 THEN 1 ELSE 0 END)
    + (CASE WHEN rr > 20e0 THEN 1 ELSE 0 END) + (CASE WHEN wbc > 12e0 OR wbc < 4e0 THEN 1 ELSE 0 END) AS s
  FROM (SELECT l.patient_id, l.obs_id AS latest_obs_id, l.hour_from_admission AS latest_hour, l.score_a AS probability,
      {f['temperature_c']} AS tmp, {f['heart_rate']} AS hr, {f['respiratory_rate']} AS rr, {f['wbc_count']} AS wbc,
      {f['lactate']} AS lac, {f['crp_level']} AS crp, a.n_readings, a.reading_hours
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY hour_from_admission DESC, obs_id DESC) AS rn
          FROM vitals) x WHERE rn = 1) l
    JOIN (SELECT patient_id, CAST(COUNT(*) AS INTEGER) AS n_readings,
            string_agg(CAST(hour_from_admission AS VARCHAR), ',' ORDER BY hour_from_admission, obs_id) AS reading_hours
          FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY hour_from_admission DESC, obs_id DESC) AS rn
                FROM vitals) y WHERE rn <= 12 GROUP BY patient_id) a ON l.patient_id = a.patient_id) z) w"""


@query("m10_patient_report", _report_sql())
def q_m10(spark, sf):
    """Per-patient report row (latest state, report tier, last 12 readings, findings, actions)."""
    r = X.patient_report(T.vitals(spark, sf))
    return r.select("patient_id", "latest_obs_id", "latest_hour", "probability", "sirs_score", "report_tier",
                    F.size("readings").alias("n_readings"),
                    F.array_join(F.transform("readings", lambda x: x["hour"].cast("string")), ",").alias("reading_hours"),
                    F.array_join("findings", " | ").alias("findings"), F.array_join("actions", " | ").alias("actions"))
