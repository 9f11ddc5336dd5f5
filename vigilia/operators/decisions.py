"""Scoring decisions (K2-K16): tiers, ensembles, disagreement alerts, routing, what-if.

Every operator takes a table with score columns, so it is independent of the
model: a row-local projection (no shuffle) except the what-if count (K16).
Cut points are arguments (a tier table row), never global state.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import constants as K
from ..functions.fmt import fmt_fixed, fmt_pct


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pct0(x: Column) -> Column:
    """Python ``{:.0%}``."""
    return fmt_pct(x, 0)


def score_decision(df: DataFrame, p: str = "risk_score") -> DataFrame:
    """K4 + K3: tier and confidence ``min(0.95, p + 0.2)``."""
    return df.withColumns({"risk_level": C.risk_tier(p), "confidence": F.least(F.lit(0.95), F.col(p) + F.lit(0.2))})


def decision(p, threshold: float = 0.5) -> Column:
    """K2: 1 when ``p >= threshold``."""
    return C.flag(_c(p) >= threshold)


def bedside_tier(p, sirs, threshold: float = 0.5) -> Column:
    """K5: decision -> HIGH; p >= 0.30 or SIRS >= 2 -> MODERATE; else LOW."""
    return (F.when(_c(p) >= threshold, "HIGH")
            .when((_c(p) >= K.BEDSIDE_MODERATE_PROB) | (_c(sirs) >= 2), "MODERATE").otherwise("LOW"))


def quick_tier(p, threshold: float = 0.5) -> Column:
    """K6: probability only."""
    return F.when(_c(p) >= threshold, "HIGH").when(_c(p) >= K.BEDSIDE_MODERATE_PROB, "MODERATE").otherwise("LOW")


def report_tier(p, sirs, threshold: float = 0.5) -> Column:
    """K7: SIRS = 3 first, then the decision, then SIRS = 2 (order kept: SIRS 4 without decision is LOW)."""
    return (F.when(_c(sirs) == 3, "MODERATE RISK").when(_c(p) >= threshold, "HIGH RISK - SEPSIS ALERT")
            .when(_c(sirs) == 2, "MILD RISK").otherwise("LOW RISK"))


def monitoring_frequency(level) -> Column:
    lv = _c(level)
    e = None
    for name, text in K.MONITORING_FREQUENCY.items():
        e = F.when(lv == name, text) if e is None else e.when(lv == name, text)
    return e


def risk_stratification(df: DataFrame, rf: str = "score_a", xgb: str = "score_b", sirs_pos: str = "sirs_positive") -> DataFrame:
    """K9: consensus of both models (mean), tier, recommendation, monitoring frequency, agreement."""
    ens = (F.col(xgb) + F.col(rf)) / 2
    agree = C.risk_tier(xgb) == C.risk_tier(rf)
    return df.select(
        "obs_id",
        C.risk_tier(ens).alias("category"),
        F.round(ens, 4).alias("ensemble_score"),
        C.recommendation(C.risk_tier(ens), sirs_pos).alias("recommendation"),
        monitoring_frequency(C.risk_tier(ens)).alias("monitoring_frequency"),
        agree.alias("models_agree"),
        F.when(agree, "HIGH").otherwise("MODERATE - models disagree, review recommended").alias("confidence"),
    )


def agreement(diff: Column) -> Column:
    return F.when(diff < 0.10, "STRONG").when(diff < 0.20, "MODERATE").otherwise("WEAK")


def weighted_ensemble(df: DataFrame, rf: str = "score_a", xgb: str = "score_b", sirs_pos: str = "sirs_positive",
                      rf_weight: float = K.ENSEMBLE_RF_WEIGHT, xgb_weight: float = K.ENSEMBLE_XGB_WEIGHT) -> DataFrame:
    """Normalised weights, weighted probability, tier, agreement, recommendation with a WEAK note."""
    total = rf_weight + xgb_weight
    rw, xw = rf_weight / total, xgb_weight / total
    prob = F.lit(rw) * F.col(rf) + F.lit(xw) * F.col(xgb)
    diff = F.abs(F.col(rf) - F.col(xgb))
    level = C.risk_tier(prob)
    rec = F.concat(C.recommendation(level, sirs_pos),
                   F.when(agreement(diff) == "WEAK", K.WEAK_AGREEMENT_NOTE).otherwise(""))
    return df.select(
        "obs_id",
        F.round(rf, 4).alias("rf_probability"), F.round(xgb, 4).alias("xgb_probability"),
        F.round(prob, 4).alias("ensemble_probability"), level.alias("ensemble_risk_level"),
        F.round(F.lit(rw), 2).alias("rf_weight"), F.round(F.lit(xw), 2).alias("xgb_weight"),
        agreement(diff).alias("model_agreement"), rec.alias("recommendation"),
    )


def mean_ensemble(df: DataFrame, cols: Sequence[str] = ("score_a", "score_b")) -> DataFrame:
    """Unweighted mean probability."""
    return df.select("obs_id", (sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)).alias("mean_probability"))


def _filled(template: str, **parts: Column) -> Column:
    """A fixed text with ``{name}`` places filled by columns."""
    bits = re.split(r"{(\w+)}", template)
    return F.concat(*[parts[b] if i % 2 else F.lit(b) for i, b in enumerate(bits) if i % 2 or b])


def disagreement_alert(df: DataFrame, rf: str = "score_a", xgb: str = "score_b") -> DataFrame:
    """NONE / ADVISORY / WARNING / CRITICAL_REVIEW, escalated when tiers are 2+ apart."""
    r, x = F.col(rf), F.col(xgb)
    lr, lx = C.risk_tier(r), C.risk_tier(x)
    diff = F.abs(r - x)
    differs = lr != lx
    rf_higher = r > x
    higher = F.when(rf_higher, "Random Forest").otherwise("XGBoost")
    lower = F.when(rf_higher, "XGBoost").otherwise("Random Forest")
    hl = F.when(rf_higher, lr).otherwise(lx)
    ll = F.when(rf_higher, lx).otherwise(lr)
    names = {"higher": higher, "lower": lower, "hl": hl, "ll": ll}
    gap = F.abs(C.tier_rank(lr) - C.tier_rank(lx))
    base = (F.when((diff < 0.10) & ~differs, "NONE").when(diff < 0.20, "ADVISORY")
            .when(diff < 0.35, "WARNING").otherwise("CRITICAL_REVIEW"))
    dtype = (F.when(base == "NONE", K.DISAGREE_NONE_TYPE)
             .when(base == "ADVISORY", _filled(K.DISAGREE_ADVISORY_TYPE, **names))
             .when(base == "WARNING", _filled(K.DISAGREE_WARNING_TYPE, **names))
             .otherwise(_filled(K.DISAGREE_CRITICAL_TYPE, **names)))
    action = (F.when(base == "NONE", K.DISAGREE_NONE_ACTION).when(base == "ADVISORY", K.DISAGREE_ADVISORY_ACTION)
              .when(base == "WARNING", K.DISAGREE_WARNING_ACTION).otherwise(K.DISAGREE_CRITICAL_ACTION))
    escalate = (gap >= 2) & (base != "CRITICAL_REVIEW")
    return df.select(
        "obs_id",
        F.when(escalate, "CRITICAL_REVIEW").otherwise(base).alias("alert_level"),
        F.round(diff, 4).alias("disagreement_score"),
        dtype.alias("disagreement_type"),
        F.when(escalate, K.DISAGREE_ESCALATE_ACTION).otherwise(action).alias("clinical_action"),
        (escalate | base.isin("WARNING", "CRITICAL_REVIEW")).alias("flagged_for_review"),
        lr.alias("rf_risk_level"), lx.alias("xgb_risk_level"),
    )


def smart_routing(df: DataFrame, rf: str = "score_a", xgb: str = "score_b", sirs_pos: str = "sirs_positive",
                  confidence_threshold: float = 0.15) -> DataFrame:
    """RF alone when confident (|p - .5| >= c) and tiers agree, else the .4/.6 ensemble."""
    r, x = F.col(rf), F.col(xgb)
    lr, lx = C.risk_tier(r), C.risk_tier(x)
    conf = F.abs(r - 0.5) * 2
    agree = lr == lx
    confident = F.abs(r - 0.5) >= confidence_threshold
    ens = F.lit(K.ENSEMBLE_RF_WEIGHT) * r + F.lit(K.ENSEMBLE_XGB_WEIGHT) * x
    routing = F.when(confident & agree, "RF_ONLY").otherwise("ENSEMBLE")
    reason = (F.when(confident & agree, F.concat(F.lit("RF confident ("), pct0(conf),
                                                 F.lit(") and both models agree on "), lr, F.lit(".")))
              .when(~confident, F.concat(F.lit("RF uncertain (confidence "), pct0(conf), F.lit(", prob="),
                                         fmt_fixed(r, 3), F.lit(" near 0.5). Escalated to ensemble.")))
              .otherwise(F.concat(F.lit("Models disagree (RF="), lr, F.lit(", XGB="), lx,
                                  F.lit("). Using ensemble for safety."))))
    final = F.when(confident & agree, r).otherwise(ens)
    level = C.risk_tier(final)
    conf_out = F.greatest(conf, F.abs(final - 0.5) * 2)
    rec = F.concat(C.recommendation(level, sirs_pos),
                   F.when((routing == "ENSEMBLE") & ~agree, K.SMART_DISAGREE_NOTE).otherwise(""))
    return df.select(
        "obs_id", routing.alias("routing_decision"), reason.alias("routing_reason"),
        F.round(r, 4).alias("primary_probability"), F.round(final, 4).alias("final_probability"),
        level.alias("final_risk_level"), F.round(conf_out, 4).alias("confidence_score"), rec.alias("recommendation"),
    )


def compare_models(df: DataFrame, rf: str = "score_a", xgb: str = "score_b") -> DataFrame:
    """Mean, max and agreement text of the two scores."""
    diff = F.abs(F.col(xgb) - F.col(rf))
    agree = (F.when(diff < 0.1, K.COMPARE_AGREEMENT[0]).when(diff < 0.2, K.COMPARE_AGREEMENT[1])
             .otherwise(K.COMPARE_AGREEMENT[2]))
    return df.select("obs_id", F.round((F.col(rf) + F.col(xgb)) / 2, 4).alias("average_score"),
                     F.round(F.greatest(rf, xgb), 4).alias("max_score"), agree.alias("agreement"))


def threshold_whatif(df: DataFrame, p: str, scenarios: dict[str, dict[str, float]]) -> DataFrame:
    """Tier counts under alternative cut points.

    Each scenario is a tier expression evaluated in the same pass; ``stack``
    turns them into (scenario, tier) rows that are counted with partial
    aggregation. No scenario table is joined to the rows.
    """
    exprs = []
    for name, t in scenarios.items():
        cuts = {**K.RISK_THRESHOLDS, **t}
        exprs.append((name, C.risk_tier(p, cuts["moderate"], cuts["high"], cuts["critical"])))
    wide = df.select(*[e.alias(f"_t{i}") for i, (_, e) in enumerate(exprs)])
    body = ", ".join(f"'{n}', _t{i}" for i, (n, _) in enumerate(exprs))
    long = wide.selectExpr(f"stack({len(exprs)}, {body}) AS (scenario, risk_level)")
    return long.groupBy("scenario", "risk_level").agg(F.count(F.lit(1)).alias("n"))


def ensemble_batch(checked: DataFrame, rf: str = "score_a", xgb: str = "score_b",
                   rf_weight: float = K.ENSEMBLE_RF_WEIGHT, xgb_weight: float = K.ENSEMBLE_XGB_WEIGHT) -> DataFrame:
    """Ensemble for valid request rows, an error row (the violations) for invalid ones.

    ``checked`` is the validated request table carrying its model scores, so the
    batch result is one projection: no join between the good and the bad rows.
    """
    total = rf_weight + xgb_weight
    prob = F.lit(rf_weight / total) * F.col(rf) + F.lit(xgb_weight / total) * F.col(xgb)
    ok = F.col("is_valid")
    return checked.select(
        "obs_id", F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(ok, F.round(prob, 4)).alias("ensemble_probability"),
        F.when(ok, C.risk_tier(prob)).alias("ensemble_risk_level"),
        F.when(~ok, F.col("violations")).alias("error"),
    )
