"""Queries: decisions on fixed scores."""

from __future__ import annotations


from ..functions import clinical as C
from ..functions import constants as K
from ..operators import decisions as D
from ..operators import quality as Q
from ..sources import tables as T
from . import expected as E
from .registry import query
from .sqlbase import q, rank_sql, rec_sql, tier_sql
from .sqlbase import with_views as W


def S(spark, sf):
    return T.scored(T.vitals(spark, sf))


@query("k2_decision", W("scored") + "SELECT obs_id, CASE WHEN score_a >= 5e-1 THEN 1 ELSE 0 END AS decision FROM scored")
def q_k2(spark, sf):
    """K2: binary decision p >= threshold."""
    return S(spark, sf).select("obs_id", D.decision("score_a").alias("decision"))


@query("k3_k4_tier_confidence", W("scored") + f"""SELECT obs_id, {tier_sql('score_b')} AS risk_level,
  LEAST(95e-2, score_b + 2e-1) AS confidence FROM scored""")
def q_k34(spark, sf):
    """K3 + K4: interface tier (.85/.7/.5) and confidence min(0.95, p + 0.2)."""
    return D.score_decision(S(spark, sf), "score_b").select("obs_id", "risk_level", "confidence")


@query("k5_k6_k7_tiers", W("scored") + """SELECT obs_id,
  CASE WHEN score_a >= 5e-1 THEN 'HIGH' WHEN score_a >= 3e-1 OR sirs_score >= 2 THEN 'MODERATE' ELSE 'LOW' END AS bedside_tier,
  CASE WHEN score_a >= 5e-1 THEN 'HIGH' WHEN score_a >= 3e-1 THEN 'MODERATE' ELSE 'LOW' END AS quick_tier,
  CASE WHEN sirs_score = 3 THEN 'MODERATE RISK' WHEN score_a >= 5e-1 THEN 'HIGH RISK - SEPSIS ALERT'
       WHEN sirs_score = 2 THEN 'MILD RISK' ELSE 'LOW RISK' END AS report_tier FROM scored""")
def q_k567(spark, sf):
    """K5 bedside, K6 quick and K7 report tiers (report order kept: SIRS=3 before the decision)."""
    return S(spark, sf).select("obs_id", D.bedside_tier("score_a", "sirs_score").alias("bedside_tier"),
                               D.quick_tier("score_a").alias("quick_tier"),
                               D.report_tier("score_a", "sirs_score").alias("report_tier"))


@query("k8_recommendation", W("scored") + f"""SELECT obs_id, risk_level, {rec_sql('risk_level', 'sirs_positive')} AS recommendation
FROM (SELECT *, {tier_sql('score_b')} AS risk_level FROM scored) t""")
def q_k8(spark, sf):
    """K8: recommendation text by tier with the SIRS suffix for HIGH / CRITICAL."""
    d = S(spark, sf).withColumn("risk_level", C.risk_tier("score_b"))
    return d.select("obs_id", "risk_level", C.recommendation("risk_level", "sirs_positive").alias("recommendation"))


def _freq_sql(level):
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN '{v}'" for k, v in K.MONITORING_FREQUENCY.items()) + " END"


@query("k9_risk_stratification", W("scored") + f"""SELECT obs_id, cat AS category, ROUND(ens, 4) AS ensemble_score,
  {rec_sql('cat', 'sirs_positive')} AS recommendation, {_freq_sql('cat')} AS monitoring_frequency,
  agree AS models_agree, CASE WHEN agree THEN 'HIGH' ELSE 'MODERATE - models disagree, review recommended' END AS confidence
FROM (SELECT *, {tier_sql('ens')} AS cat FROM (SELECT *, (score_b + score_a) / 2e0 AS ens,
  ({tier_sql('score_b')}) = ({tier_sql('score_a')}) AS agree FROM scored) a) b""")
def q_k9(spark, sf):
    """K9: two-model consensus, tier, recommendation, monitoring frequency, agreement."""
    return D.risk_stratification(S(spark, sf))


def _agree_sql(diff):
    return f"CASE WHEN {diff} < 1e-1 THEN 'STRONG' WHEN {diff} < 2e-1 THEN 'MODERATE' ELSE 'WEAK' END"


@query("k10_weighted_ensemble", W("scored") + f"""SELECT obs_id, ROUND(score_a, 4) AS rf_probability,
  ROUND(score_b, 4) AS xgb_probability, ROUND(p, 4) AS ensemble_probability, lvl AS ensemble_risk_level,
  ROUND(4e-1, 2) AS rf_weight, ROUND(6e-1, 2) AS xgb_weight, {_agree_sql('d')} AS model_agreement,
  {rec_sql('lvl', 'sirs_positive')} || CASE WHEN {_agree_sql('d')} = 'WEAK' THEN {q(K.WEAK_AGREEMENT_NOTE)} ELSE '' END
    AS recommendation
FROM (SELECT *, {tier_sql('p')} AS lvl FROM (SELECT *, 4e-1 * score_a + 6e-1 * score_b AS p,
  abs(score_a - score_b) AS d FROM scored) a) b""")
def q_k10(spark, sf):
    """Weighted ensemble (.4 / .6, normalised), tier, agreement, recommendation with a WEAK note."""
    return D.weighted_ensemble(S(spark, sf))


@query("k12_mean_ensemble", W("scored") + "SELECT obs_id, (0e0 + score_a + score_b) / 2 AS mean_probability FROM scored")
def q_k12(spark, sf):
    """Unweighted ensemble (mean probability)."""
    return D.mean_ensemble(S(spark, sf))


def _disagree_sql():
    higher = "CASE WHEN score_a > score_b THEN 'Random Forest' ELSE 'XGBoost' END"
    lower = "CASE WHEN score_a > score_b THEN 'XGBoost' ELSE 'Random Forest' END"
    hl = "CASE WHEN score_a > score_b THEN lr ELSE lx END"
    ll = "CASE WHEN score_a > score_b THEN lx ELSE lr END"
    return W("scored") + f"""SELECT obs_id, CASE WHEN esc THEN 'CRITICAL_REVIEW' ELSE base END AS alert_level,
  ROUND(d, 4) AS disagreement_score,
  CASE WHEN base = 'NONE' THEN {q(K.DISAGREE_NONE_TYPE)}
       WHEN base = 'ADVISORY' THEN 'Minor divergence — ' || {higher} || ' rates higher risk'
       WHEN base = 'WARNING' THEN 'Significant divergence — ' || {higher} || ' (' || {hl} || ') vs ' || {lower} || ' (' || {ll} || ')'
       ELSE 'Major divergence — ' || {higher} || ' (' || {hl} || ') vs ' || {lower} || ' (' || {ll} || ')' END AS disagreement_type,
  CASE WHEN esc THEN {q(K.DISAGREE_ESCALATE_ACTION)} WHEN base = 'NONE' THEN {q(K.DISAGREE_NONE_ACTION)}
       WHEN base = 'ADVISORY' THEN {q(K.DISAGREE_ADVISORY_ACTION)} WHEN base = 'WARNING' THEN {q(K.DISAGREE_WARNING_ACTION)}
       ELSE {q(K.DISAGREE_CRITICAL_ACTION)} END AS clinical_action,
  esc OR base IN ('WARNING', 'CRITICAL_REVIEW') AS flagged_for_review, lr AS rf_risk_level, lx AS xgb_risk_level
FROM (SELECT *, abs({rank_sql('lr')} - {rank_sql('lx')}) >= 2 AND base <> 'CRITICAL_REVIEW' AS esc FROM (
  SELECT *, CASE WHEN d < 1e-1 AND lr = lx THEN 'NONE' WHEN d < 2e-1 THEN 'ADVISORY' WHEN d < 35e-2 THEN 'WARNING'
                 ELSE 'CRITICAL_REVIEW' END AS base FROM (
    SELECT obs_id, score_a, score_b, abs(score_a - score_b) AS d, {tier_sql('score_a')} AS lr, {tier_sql('score_b')} AS lx
    FROM scored) a) b) c"""


@query("k13_disagreement_alert", _disagree_sql())
def q_k13(spark, sf):
    """Disagreement alert level, type, action and review flag; escalation on a 2+ tier gap."""
    return D.disagreement_alert(S(spark, sf))


def _smart_sql():
    pct = "CAST(round_even(conf * 100, 0) AS BIGINT) || '%'"
    return W("scored") + f"""SELECT obs_id, CASE WHEN ok THEN 'RF_ONLY' ELSE 'ENSEMBLE' END AS routing_decision,
  CASE WHEN ok THEN 'RF confident (' || {pct} || ') and both models agree on ' || lr || '.'
       WHEN NOT confident THEN 'RF uncertain (confidence ' || {pct} || ', prob=' || printf('%.3f', score_a) || ' near 0.5). Escalated to ensemble.'
       ELSE 'Models disagree (RF=' || lr || ', XGB=' || lx || '). Using ensemble for safety.' END AS routing_reason,
  ROUND(score_a, 4) AS primary_probability, ROUND(fin, 4) AS final_probability, {tier_sql('fin')} AS final_risk_level,
  ROUND(GREATEST(conf, abs(fin - 5e-1) * 2), 4) AS confidence_score,
  {rec_sql(tier_sql('fin'), 'sirs_positive')} || CASE WHEN NOT ok AND lr <> lx THEN {q(K.SMART_DISAGREE_NOTE)} ELSE '' END
    AS recommendation
FROM (SELECT *, CASE WHEN ok THEN score_a ELSE 4e-1 * score_a + 6e-1 * score_b END AS fin FROM (
  SELECT *, confident AND lr = lx AS ok FROM (
    SELECT obs_id, score_a, score_b, sirs_positive, abs(score_a - 5e-1) * 2 AS conf, abs(score_a - 5e-1) >= 15e-2 AS confident,
      {tier_sql('score_a')} AS lr, {tier_sql('score_b')} AS lx FROM scored) a) b) c"""


@query("k14_smart_routing", _smart_sql())
def q_k14(spark, sf):
    """Confidence routing (RF alone when confident and agreeing, else ensemble) with reason text."""
    return D.smart_routing(S(spark, sf))


@query("k15_compare_models", W("scored") + f"""SELECT obs_id, ROUND((score_a + score_b) / 2, 4) AS average_score,
  ROUND(GREATEST(score_a, score_b), 4) AS max_score,
  CASE WHEN abs(score_b - score_a) < 1e-1 THEN {q(K.COMPARE_AGREEMENT[0])}
       WHEN abs(score_b - score_a) < 2e-1 THEN {q(K.COMPARE_AGREEMENT[1])} ELSE {q(K.COMPARE_AGREEMENT[2])} END AS agreement
FROM scored""")
def q_k15(spark, sf):
    """Side-by-side comparison: mean, max, agreement text."""
    return D.compare_models(S(spark, sf))


WHATIF = {"baseline": {}, "high_0.6": {"high": 0.6}, "critical_0.8": {"critical": 0.8},
          "moderate_0.4": {"moderate": 0.4}}


def _whatif_sql():
    parts = []
    for name, t in WHATIF.items():
        c = {**E.RISK_CUTS, **t}
        parts.append(f"SELECT '{name}' AS scenario, "
                     f"{tier_sql('score_b', repr(c['moderate']) + 'e0', repr(c['high']) + 'e0', repr(c['critical']) + 'e0')}"
                     " AS risk_level FROM scored")
    return W("scored", extra="s AS (" + " UNION ALL ".join(parts) + ")") + \
        "SELECT scenario, risk_level, CAST(COUNT(*) AS BIGINT) AS n FROM s GROUP BY scenario, risk_level"


@query("k16_threshold_whatif", _whatif_sql())
def q_k16(spark, sf):
    """Tier counts under alternative cut points (scenarios as parallel expressions, one pass)."""
    return D.threshold_whatif(S(spark, sf), "score_b", WHATIF)


def _batch_sql():
    from .catalog_quality import CHECKED
    return CHECKED() + f"""SELECT obs_id, CASE WHEN is_valid THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN is_valid THEN ROUND(4e-1 * score_a + 6e-1 * score_b, 4) END AS ensemble_probability,
  CASE WHEN is_valid THEN {tier_sql('(4e-1 * score_a + 6e-1 * score_b)')} END AS ensemble_risk_level,
  CASE WHEN NOT is_valid THEN violations END AS error FROM chk"""


@query("k11_ensemble_batch", _batch_sql())
def q_k11(spark, sf):
    """Ensemble batch: valid requests scored, invalid ones returned as error rows."""
    v = T.vitals(spark, sf)
    checked = Q.validate_requests(Q.requests_from_vitals(v, extra=["score_a", "score_b"]))
    return D.ensemble_batch(checked)
