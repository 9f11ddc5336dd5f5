"""Explanations and report tables.

Per-observation factor lists are arrays of structs inside the row, so ranking
("top k by |impact|, ties in feature order") is a row-local ``sort_array`` +
``slice``: no shuffle, no per-observation group. Long forms come from
``posexplode``. Texts use the Python-compatible formatter (``functions.fmt``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import constants as K
from ..functions.fmt import fmt_fixed, fmt_pct, py_str
from . import decisions as D
from . import sequence as S

FACTOR_TYPE = "array<struct<neg_abs:double,ord:int,feature:string,value:double,impact:double>>"


# ------------------------------------------------------------------ factor arrays
def factor_array(features: Sequence[str], value: dict[str, Column], impact: dict[str, Column]) -> Column:
    """array<struct<neg_abs, ord, feature, value, impact>> in feature order."""
    return F.array(*[F.struct((-F.abs(impact[f])).alias("neg_abs"), F.lit(k).alias("ord"), F.lit(f).alias("feature"),
                              value[f].cast("double").alias("value"), impact[f].cast("double").alias("impact"))
                     for k, f in enumerate(features)])


def rank_factors(arr: Column, k: int | None = None, drop_null: bool = False) -> Column:
    """Sort by |impact| descending, ties in feature order (stable sort of the reference); keep k.

    ``drop_null`` removes factors without an impact first (missing readings).
    """
    s = F.sort_array(F.filter(arr, lambda x: x["impact"].isNotNull()) if drop_null else arr)
    return F.slice(s, 1, k) if k else s


def ranked_long(df: DataFrame, arr: str, keep: Sequence[str] = ("obs_id",), k: int | None = None) -> DataFrame:
    """One row per (observation, rank) with rank 1 = largest |impact|."""
    return df.select(*keep, F.posexplode(rank_factors(F.col(arr), k)).alias("pos", "f")).select(
        *keep, (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.feature").alias("feature"),
        F.col("f.value").alias("value"), F.col("f.impact").alias("impact"))


# ------------------------------------------------------------------ ranges
def _map_literal(d: dict) -> Column:
    """A map literal as one expression (a lookup is one node, not a CASE chain per key)."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(float(v)) + "D"
    return F.expr("map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in d.items()) + ")")


_LO = {p: lo for p, (lo, hi, u) in K.NORMAL_RANGES.items()}
_HI = {p: hi for p, (lo, hi, u) in K.NORMAL_RANGES.items()}
_UNIT = {p: u for p, (lo, hi, u) in K.NORMAL_RANGES.items()}


def _range_of(feature: Column):
    """Low, high, unit and range text of a table parameter (NULL when it has no normal range)."""
    return (F.try_element_at(_map_literal(_LO), feature), F.try_element_at(_map_literal(_HI), feature),
            F.try_element_at(_map_literal(_UNIT), feature), F.try_element_at(_map_literal(K.NORMAL_RANGE_TEXT), feature))


def display_name(feature: Column, width: int | None = None) -> Column:
    """Display name, default the raw name; optionally truncated like ``[:width]``."""
    name = F.coalesce(F.try_element_at(_map_literal(K.FEATURE_NAMES), feature), feature)
    return F.substring(name, 1, width) if width else name


def range_status(long: DataFrame, parameter: str = "parameter", value: str = "value") -> DataFrame:
    """LOW / HIGH / normal, value text with '*' when outside, status text (table ranges).

    Lookups and the formatted value are projected first so the text expressions
    stay small enough for generated code.
    """
    lo, hi, unit, txt = _range_of(F.col(parameter))
    d = long.withColumns({"_lo": lo, "_hi": hi, "_unit": unit, "_txt": txt, "_v1": fmt_fixed(F.col(value), 1)})
    v, lo, hi, unit, txt, v1 = (F.col(c) for c in (value, "_lo", "_hi", "_unit", "_txt", "_v1"))
    status = F.when(v < lo, "LOW").when(v > hi, "HIGH").when(v.isNotNull(), "normal")
    rng = F.concat(v1, F.lit(" "), unit, F.lit(", normal: "), txt, F.lit(")"))
    text = (F.when(v < lo, F.concat(F.lit("below normal ("), rng)).when(v > hi, F.concat(F.lit("above normal ("), rng))
            .when(v.isNotNull(), F.concat(F.lit("normal ("), v1, F.lit(" "), unit, F.lit(")"))))
    return d.withColumns({"status": status,
                          "value_text": F.concat(v1, F.when((v < lo) | (v > hi), "*").otherwise("")),
                          "status_text": text}).drop("_lo", "_hi", "_unit", "_txt", "_v1")


def range_position(long: DataFrame, parameter: str = "parameter", value: str = "value") -> DataFrame:
    """Position in the normal range, (v - mid) / half_range * 50 + 50 (50 = centre)."""
    lo, hi, _, _ = _range_of(F.col(parameter))
    mid = (lo + hi) / 2
    half = (hi - lo) / 2
    return long.withColumn("position", (F.col(value) - mid) / half * 50 + 50)


# ------------------------------------------------------------------ M1-M3 (request interface)
def deviation_importance(req: DataFrame, k: int = 5) -> Column:
    """M1: ``min(|v - mid| / mid, 0.5)`` per interface parameter, top k (ties in field order)."""
    items = []
    for p, (lo, hi, _u) in K.NORMAL_RANGES.items():
        a = K.API_NAME.get(p, p)
        mid = (lo + hi) / 2
        # least() skips NULL, so a missing reading must be guarded or it would score 0.5
        imp = F.when(F.col(a).isNotNull(), F.least(F.abs(F.col(a) - F.lit(mid)) / F.lit(mid), F.lit(0.5)))
        items.append((K.API_PARAMETERS.index(a), a, imp))
    items.sort()
    arr = F.array(*[F.struct((-imp).alias("neg_abs"), F.lit(o).alias("ord"), F.lit(a).alias("feature"),
                             F.col(a).cast("double").alias("value"), imp.alias("impact")) for o, a, imp in items])
    return rank_factors(arr, k, drop_null=True)


def doctor_text(p: Column, top: Column) -> Column:
    """M2: clinician text: score, top 3 parameters with value, unit and impact, interpretation at .7 / .5.

    ``top`` should be a column reference (materialise the ranked list first).
    """
    def line(i):
        x = F.element_at(top, i)
        unit = None
        for a, u in K.API_UNIT.items():
            unit = F.when(x["feature"] == a, F.lit(u)) if unit is None else unit.when(x["feature"] == a, F.lit(u))
        return F.when(F.size(top) >= i, F.concat(F.lit("\n- "), x["feature"], F.lit(": "), py_str(x["value"]), F.lit(" "),
                                                 F.coalesce(unit, F.lit("")), F.lit(" (Impact: "), fmt_pct(x["impact"], 1),
                                                 F.lit(")"))).otherwise(F.lit(""))
    interp = (F.when(p > 0.7, F.lit("\n" + K.DOCTOR_HIGH)).when(p > 0.5, F.lit("\n" + K.DOCTOR_MODERATE))
              .otherwise(F.lit("\n" + K.DOCTOR_LOW)))
    return F.concat(F.lit(K.DOCTOR_HEADER), fmt_pct(p, 1), F.lit("\n\nKey Clinical Parameters:\n"),
                    line(1), line(2), line(3), F.lit("\n\nClinical Interpretation:"), interp)


def patient_text(p: Column, level: Column) -> Column:
    """M3: patient text by tier (whole-percent score)."""
    para = None
    for lv, t in K.PATIENT_TEXT.items():
        para = F.when(level == lv, F.lit(t)) if para is None else para.when(level == lv, F.lit(t))
    return F.concat(F.lit(K.PATIENT_HEADER), level, F.lit("\nRisk Score: "), fmt_pct(p, 0),
                    F.lit("\n\nWhat does this mean?\n"), F.lit("\n"), para, F.lit("\n"), F.lit(K.PATIENT_FOOTER))


def bedside_patient_text(p: Column, sirs_score: Column, threshold: float = 0.5) -> Column:
    """M3, bedside form: paragraph for patients and families (decision, then score .3 or two SIRS criteria)."""
    t = K.BEDSIDE_PATIENT_TEXT
    return (F.when(p >= threshold, F.lit(t["high"])).when((p >= 0.30) | (sirs_score >= 2), F.lit(t["moderate"]))
            .otherwise(F.lit(t["low"])))


# ------------------------------------------------------------------ M6-M9 (bedside / report)
def impact_rows(df: DataFrame, arr: str, k: int = 10, keep: Sequence[str] = ("obs_id",), report: bool = False) -> DataFrame:
    """M6: top-k impact table. Bedside form: display name (28 chars), value text (* outside range), signed impact,
    direction; report form: 35 chars, value with unit, |impact|, Increases / Decreases / Neutral."""
    long = ranked_long(df, arr, keep, k)
    lo, hi, unit, _ = _range_of(F.col("feature"))
    if report:
        long = long.withColumns({"_lo": lo, "_hi": hi, "_unit": unit, "_imp": fmt_fixed(F.abs(F.col("impact")), 4)})
        v = F.col("value")
        star = F.when((v < F.col("_lo")) | (v > F.col("_hi")), "* ").otherwise(" ")
        vtxt = F.when(F.col("_lo").isNotNull(), F.concat(fmt_fixed(v, 1), star, F.col("_unit"))).otherwise(fmt_fixed(v, 2))
        way = F.when(F.col("impact") > 0, "Increases").when(F.col("impact") < 0, "Decreases").otherwise("Neutral")
        return long.select(*keep, "rank", "feature", display_name(F.col("feature"), 35).alias("display_name"),
                           vtxt.alias("value_text"), F.col("_imp").alias("impact_text"), way.alias("direction"))
    long = long.withColumns({"_lo": lo, "_hi": hi, "_imp": fmt_fixed(F.col("impact"), 4, plus=True)})
    v = F.col("value")
    outside = (v < F.col("_lo")) | (v > F.col("_hi"))
    vtxt = F.when(F.col("_lo").isNotNull(), F.concat(fmt_fixed(v, 1), F.when(outside, "*").otherwise(""))) \
        .otherwise(fmt_fixed(v, 2))
    direction = F.when(F.col("impact") > 0, "^ Risk").when(F.col("impact") < 0, "v Risk").otherwise("-")
    return long.select(*keep, "rank", "feature", display_name(F.col("feature"), 28).alias("display_name"),
                       vtxt.alias("value_text"), F.col("_imp").alias("impact_text"), direction.alias("direction"))


def _factor_text(x: Column, risk: bool, script: bool) -> Column:
    f, v = x["feature"], x["value"]
    lo, hi, unit, txt = _range_of(f)
    inr = f.isin(*K.NORMAL_RANGES)
    if script:  # the script's own table writes the unit of temperature in another way
        unit = F.when(f == "temperature_c", F.lit(K.SCRIPT_TEMPERATURE_UNIT)).otherwise(unit)
    v1 = fmt_fixed(v, 1)
    below = F.concat(F.lit("below normal ("), v1, F.lit(" "), unit, F.lit(", normal: "), txt, F.lit(")"))
    above = F.concat(F.lit("above normal ("), v1, F.lit(" "), unit, F.lit(", normal: "), txt, F.lit(")"))
    normal = F.concat(F.lit("normal ("), v1, F.lit(" "), unit, F.lit(")"))
    plain = F.concat(F.lit("value: "), v1)
    if script:
        status = F.when(inr & (v < lo), below).when(inr & (v > hi), above).when(inr, normal).otherwise(plain)
    elif risk:
        status = F.when(inr & (v < lo), below).when(inr & (v > hi), above).otherwise(plain)
    else:
        status = F.when(inr & (v >= lo) & (v <= hi), normal).otherwise(plain)
    return F.concat(display_name(f), F.lit(": "), status)


def risk_protective(arr: Column, variant: str = "bedside") -> tuple[Column, Column]:
    """Risk and protective factor texts from the top factors.

    bedside: top 10, impact > 0.02 risk / < -0.02 protective; script: top 8 and
    |impact| > 0.05 first. First 5 risk and first 3 protective are kept.
    """
    script = variant == "script"
    top = rank_factors(arr, 8 if script else 10)
    if script:
        top = F.filter(top, lambda x: F.abs(x["impact"]) > 0.05)
    risk = F.slice(F.filter(top, lambda x: x["impact"] > 0.02), 1, 5)
    prot = F.slice(F.filter(top, lambda x: x["impact"] < -0.02), 1, 3)
    return (F.array_join(F.transform(risk, lambda x: _factor_text(x, True, script)), " | "),
            F.array_join(F.transform(prot, lambda x: _factor_text(x, False, script)), " | "))


def key_points(lactate="lactate", wbc="wbc_count", crp="crp_level", temp="temperature_c", hr="heart_rate",
               sirs="sirs_score") -> Column:
    """M8 (bedside): ordered rule list; NULL readings never fire."""
    c = C.col_or
    t = K.KEY_POINT_TEXT
    rules = [
        (c(lactate) > 2.0, F.lit(t[0])),
        ((c(wbc) > 12) | (c(wbc) < 4), F.lit(t[1])),
        (c(crp) > 10, F.lit(t[2])),
        ((c(temp) > 38) | (c(temp) < 36), F.lit(t[3])),
        (c(hr) > 100, F.lit(t[4])),
        (c(sirs) >= 2, F.concat(F.lit("SIRS criteria met ("), c(sirs).cast("string"), F.lit("/4): body shows signs of stress"))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), txt) for cond, txt in rules]))


def report_findings(lactate="lactate", wbc="wbc_count", crp="crp_level", temp="temperature_c", hr="heart_rate",
                    sirs="sirs_score") -> Column:
    """M8 (report): findings with values; 'No major abnormalities ...' when none fire."""
    c = C.col_or
    R = K.REPORT_FINDINGS

    def txt(key, v):
        pre, d, suf = R[key]
        return F.concat(F.lit(pre), fmt_fixed(v, d) if d is not None else v.cast("string"), F.lit(suf))
    rules = [
        (c(lactate) > 2.0, txt("lactate_high", c(lactate))),
        (c(wbc) > 12, txt("wbc_high", c(wbc))),
        ((c(wbc) <= 12) & (c(wbc) < 4), txt("wbc_low", c(wbc))),
        (c(crp) > 10, txt("crp_high", c(crp))),
        (c(temp) > 38, txt("fever", c(temp))),
        ((c(temp) <= 38) & (c(temp) < 36), txt("hypothermia", c(temp))),
        (c(hr) > 100, txt("tachycardia", c(hr))),
        (c(sirs) >= 2, txt("sirs", c(sirs))),
    ]
    arr = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), t) for cond, t in rules]))
    return F.when(F.size(arr) == 0, F.array(F.lit(K.NO_FINDINGS))).otherwise(arr)


def actions(p, sirs, threshold: float = 0.5) -> Column:
    """M9: action list by decision / p >= .30 or SIRS >= 2 / else."""
    lit_arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    return (F.when(C.col_or(p) >= threshold, lit_arr(K.ACTIONS_HIGH))
            .when((C.col_or(p) >= K.BEDSIDE_MODERATE_PROB) | (C.col_or(sirs) >= 2), lit_arr(K.ACTIONS_MODERATE))
            .otherwise(lit_arr(K.ACTIONS_LOW)))


# ------------------------------------------------------------------ C6, M10 (per patient)
READING_FIELDS = ["heart_rate", "respiratory_rate", "temperature_c", "systolic_bp", "diastolic_bp", "spo2_pct",
                  "oxygen_flow", "lactate", "wbc_count", "crp_level", "creatinine"]


def latest_as_of(df: DataFrame, at_hour: int | None = None, key: str = "patient_id",
                 hour: str = "hour_from_admission", cols: Sequence[str] = ()) -> DataFrame:
    """Latest reading at or before ``at_hour`` per patient: ``max_by(struct, (hour, obs_id))``.

    A grouped aggregation with partial aggregation, so a hot patient is reduced
    map-side before the shuffle.
    """
    d = df if at_hour is None else df.filter(F.col(hour) <= at_hour)
    cols = list(cols) or [c for c in df.columns if c not in (key,)]
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(hour), F.col("obs_id")))
    return d.groupBy(key).agg(last.alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in cols])


def patient_report(v: DataFrame, p: str = "score_a", threshold: float = 0.5, last_k: int = 12,
                   hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """One report row per patient: latest state with defaults, SIRS, report tier, last readings,
    findings and actions. The last-k readings come from the two-stage top-k, so the
    collected array per patient is bounded by ``last_k``.
    """
    sv = C.with_sirs(v, keep_parts=False)
    last = S.top_k_per_key(sv, "patient_id", [F.col("hour_from_admission").desc(), F.col("obs_id").desc()], last_k,
                           chunk_basis=F.col("hour_from_admission"), hot_rows=hot_rows)
    reading = F.struct(F.col("hour_from_admission").alias("hour"), *[F.col(c) for c in READING_FIELDS])
    agg = last.groupBy("patient_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("hour_from_admission"), F.col("obs_id"), reading.alias("r")))).alias("_rs"),
        F.max_by(F.struct(*[F.col(c) for c in ["obs_id", "hour_from_admission", p] + READING_FIELDS]),
                 F.struct("hour_from_admission", "obs_id")).alias("_l"))
    latest = {c: F.col(f"_l.{c}") for c in READING_FIELDS}
    filled = {c: F.coalesce(latest[c], F.lit(float(K.REPORT_DEFAULTS[c]))) for c in READING_FIELDS}
    sirs = C.sirs_score(filled["temperature_c"], filled["heart_rate"], filled["respiratory_rate"], filled["wbc_count"])
    prob = F.col(f"_l.{p}")
    return agg.select(
        "patient_id",
        F.col("_l.obs_id").alias("latest_obs_id"),
        F.col("_l.hour_from_admission").alias("latest_hour"),
        prob.alias("probability"),
        sirs.alias("sirs_score"),
        D.report_tier(prob, sirs, threshold).alias("report_tier"),
        F.transform("_rs", lambda x: x["r"]).alias("readings"),
        report_findings(filled["lactate"], filled["wbc_count"], filled["crp_level"], filled["temperature_c"],
                        filled["heart_rate"], sirs).alias("findings"),
        actions(prob, sirs, threshold).alias("actions"),
    )


def report_name(patient: Column, at: Column | None = None) -> Column:
    """H5s: name of a patient's report file with a time stamp (now, unless given)."""
    stamp = F.date_format(at if at is not None else F.current_timestamp(), "yyyyMMdd_HHmmss")
    return F.concat(F.lit("reports/sepsis_report_"), patient.cast("string"), F.lit("_"), stamp, F.lit(".pdf"))
