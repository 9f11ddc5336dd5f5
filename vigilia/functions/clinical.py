"""Column expressions shared by all operators (JVM-side, codegen friendly).

Null rules (pandas parity): a comparison on a missing value gives flag 0, so
every flag is ``when(cond, 1).otherwise(0)``; clipping keeps NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """1 when ``cond`` is true, else 0 (NULL counts as false)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Read NaN as NULL (Spark orders NaN above every number, pandas treats it as missing)."""
    dtypes = dict(df.dtypes)
    cols = [c for c in (cols or df.columns) if dtypes.get(c) in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols}) if cols else df


# ------------------------------------------------------------------ SIRS (B1, B2)
def sirs_temp(temp: str | Column = "temperature_c") -> Column:
    t = col_or(temp)
    return flag((t > K.SIRS_TEMP_HIGH) | (t < K.SIRS_TEMP_LOW))


def sirs_hr(hr: str | Column = "heart_rate") -> Column:
    return flag(col_or(hr) > K.SIRS_HR)


def sirs_rr(rr: str | Column = "respiratory_rate") -> Column:
    return flag(col_or(rr) > K.SIRS_RR)


def sirs_wbc_high(wbc: str | Column = "wbc_count") -> Column:
    return flag(col_or(wbc) > K.SIRS_WBC_HIGH)


def sirs_wbc_low(wbc: str | Column = "wbc_count") -> Column:
    return flag(col_or(wbc) < K.SIRS_WBC_LOW)


def sirs_wbc(wbc: str | Column = "wbc_count") -> Column:
    w = col_or(wbc)
    return flag((w > K.SIRS_WBC_HIGH) | (w < K.SIRS_WBC_LOW))


def sirs_score(temp="temperature_c", hr="heart_rate", rr="respiratory_rate", wbc="wbc_count") -> Column:
    return sirs_temp(temp) + sirs_hr(hr) + sirs_rr(rr) + sirs_wbc(wbc)


def sirs_positive(score: str | Column = "sirs_score") -> Column:
    return flag(col_or(score) >= K.SIRS_POSITIVE_MIN)


def with_sirs(df: DataFrame, keep_parts: bool = True, temp: str = "temperature_c") -> DataFrame:
    """Add the four SIRS flags, ``sirs_score`` (0-4) and ``sirs_positive``."""
    out = df.withColumns({
        "sirs_temp": sirs_temp(temp),
        "sirs_hr": sirs_hr(),
        "sirs_rr": sirs_rr(),
        "sirs_wbc": sirs_wbc(),
    })
    out = out.withColumn("sirs_score", F.col("sirs_temp") + F.col("sirs_hr") + F.col("sirs_rr") + F.col("sirs_wbc"))
    out = out.withColumn("sirs_positive", sirs_positive("sirs_score"))
    return out if keep_parts else out.drop("sirs_temp", "sirs_hr", "sirs_rr", "sirs_wbc")


def sepsis_now(score: str | Column = "sepsis_risk_score") -> Column:
    """Current sepsis flag."""
    return flag(col_or(score) >= K.SEPSIS_SCORE_CUT)


def organ_dysfunction(lactate="lactate", crp="crp_level", sbp="systolic_bp", spo2="spo2_pct") -> Column:
    """Any of lactate >= 2, CRP >= 10, SBP < 90, SpO2 < 92 (NULL -> false)."""
    cond = (
        (col_or(lactate) >= K.ORGAN_LACTATE)
        | (col_or(crp) >= K.ORGAN_CRP)
        | (col_or(sbp) < K.ORGAN_SBP)
        | (col_or(spo2) < K.ORGAN_SPO2)
    )
    return F.coalesce(cond, F.lit(False))


def clip(c: str | Column, low: float, high: float) -> Column:
    """Clip keeping NULL (``greatest``/``least`` would turn NULL into a bound)."""
    x = col_or(c)
    return F.when(x.isNull(), x).otherwise(F.greatest(F.least(x, F.lit(high)), F.lit(low)))


# ------------------------------------------------------------------ tiers (K4-K7)
def risk_tier(p: str | Column, moderate: float | Column = K.RISK_THRESHOLDS["moderate"],
              high: float | Column = K.RISK_THRESHOLDS["high"],
              critical: float | Column = K.RISK_THRESHOLDS["critical"]) -> Column:
    """K4: >= critical CRITICAL, >= high HIGH, >= moderate MODERATE, else LOW."""
    x = col_or(p)
    return (F.when(x >= critical, "CRITICAL").when(x >= high, "HIGH")
            .when(x >= moderate, "MODERATE").otherwise("LOW"))


def tier_rank(level: str | Column) -> Column:
    x = col_or(level)
    expr = None
    for name, rank in K.RISK_ORDER.items():
        expr = F.when(x == name, rank) if expr is None else expr.when(x == name, rank)
    return expr


def recommendation(level: str | Column, sirs_pos: str | Column) -> Column:
    """K8: text by tier, plus the SIRS suffix for HIGH / CRITICAL when SIRS positive."""
    lv = col_or(level)
    base = None
    for name, text in K.RECOMMENDATIONS.items():
        base = F.when(lv == name, text) if base is None else base.when(lv == name, text)
    base = base.otherwise("Monitor patient closely")
    sp = col_or(sirs_pos)
    suffix = F.when(sp.cast("boolean") & lv.isin("HIGH", "CRITICAL"), K.RECOMMENDATION_SIRS_SUFFIX).otherwise("")
    return F.concat(base, suffix)


def sirs_criteria(temp="temperature_c", hr="heart_rate", rr="respiratory_rate", wbc="wbc_count") -> Column:
    """Names of the SIRS criteria met, in rule order (an array without NULLs)."""
    t, h, r, w = col_or(temp), col_or(hr), col_or(rr), col_or(wbc)
    names = K.SIRS_CRITERIA_TEXT
    return F.array_compact(F.array(
        F.when((t < K.SIRS_TEMP_LOW) | (t > K.SIRS_TEMP_HIGH), F.lit(names[0])),
        F.when(h > K.SIRS_HR, F.lit(names[1])),
        F.when(r > K.SIRS_RR, F.lit(names[2])),
        F.when((w < K.SIRS_WBC_LOW) | (w > K.SIRS_WBC_HIGH), F.lit(names[3])),
    ))


def sirs_interpretation(positive: Column) -> Column:
    return F.when(positive, K.SIRS_INTERPRETATION[0]).otherwise(K.SIRS_INTERPRETATION[1])
