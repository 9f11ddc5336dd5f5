"""Outcome labels.

Label A: any current sepsis (``sepsis_risk_score >= 0.7``) in the hours
(t, t + horizon] of the same patient. Label B: SIRS-positive flag six rows
ahead. Label C: SIRS-positive and organ dysfunction in the same hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import constants as K
from . import sequence as S


def label_future_sepsis(df: DataFrame, *, key: str = "patient_id", hour: str = "hour_from_admission",
                        horizon: int = K.HORIZON_HOURS, out: str = "sepsis_next_6h",
                        hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """E3 (label A): RANGE frame ``(1 following, horizon following)`` over integer hours.

    O(n log n) per patient (sort + sliding frame) instead of the O(n^2) mask;
    hot patients are split into hour chunks with a ``horizon``-hour halo.
    """
    d = df.withColumn("sepsis", C.sepsis_now())

    def rng(x: DataFrame, parts: list) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(F.col(hour)).rangeBetween(1, horizon)
        return x.withColumn(out, F.coalesce(F.max("sepsis").over(w), F.lit(0)))

    return S.sequence_windows(d, key, [hour, "obs_id"] if "obs_id" in df.columns else [hour],
                              chunk_basis=F.col(hour), range_fn=rng, range_fwd=horizon, hot_rows=hot_rows)


def label_future_sepsis_join(df: DataFrame, *, key: str = "patient_id", hour: str = "hour_from_admission",
                             horizon: int = K.HORIZON_HOURS, out: str = "sepsis_next_6h") -> DataFrame:
    """C3, second form: interval match as an equi-join.

    Every sepsis hour s is expanded to the observation hours s-1 .. s-horizon that
    it labels (integer hours), de-duplicated, and the observations are left-joined
    on (key, hour). Linear in rows, no per-patient quadratic mask. A NULL patient is a
    patient, as in the window form.
    """
    d = df.withColumn("sepsis", C.sepsis_now())
    onset = (d.filter(F.col("sepsis") == 1)
             .select(key, F.explode(F.sequence(F.col(hour) - horizon, F.col(hour) - 1)).alias("_h"))
             .distinct().withColumn("_hit", F.lit(1)).withColumnRenamed(key, "_k"))
    return (d.join(onset, F.col(key).eqNullSafe(F.col("_k")) & (F.col(hour) == F.col("_h")), "left").drop("_k", "_h")
            .withColumn(out, F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit"))


def label_sirs_ahead(df: DataFrame, *, key: str | None = "patient_id", hour: str = "hour_from_admission",
                     rows_ahead: int = 6, out: str = "sirs_positive_6h",
                     hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """E4 (label B): ``sirs_positive`` six rows ahead within the patient (NULL at the end).

    ``key=None`` gives the literal whole-table form (crosses patients), computed
    with a distributed row number and an equi-join on ``rn + rows_ahead``.
    """
    d = df if "sirs_positive" in df.columns else C.with_sirs(df, keep_parts=False)
    if key is None:
        from . import prefix
        order = ["patient_id", hour] if "line_no" not in d.columns else ["line_no"]
        n = prefix.global_row_number(d, order, "_rn")
        ahead = n.select((F.col("_rn") - rows_ahead).alias("_rn"), F.col("sirs_positive").alias(out))
        return n.join(ahead, on="_rn", how="left").drop("_rn")

    def rows(x: DataFrame, parts: list) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(F.col(hour), F.col("obs_id"))
        return x.withColumn(out, F.lead("sirs_positive", rows_ahead).over(w))

    return S.sequence_windows(d, key, [hour, "obs_id"], chunk_basis=F.col(hour), rows_fn=rows,
                              rows_fwd=rows_ahead, hot_rows=hot_rows)


def label_sirs_organ(df: DataFrame, out: str = "sepsis_label") -> DataFrame:
    """B6 / label C: SIRS positive and organ dysfunction in the same hour."""
    d = df if "sirs_positive" in df.columns else C.with_sirs(df, keep_parts=False)
    return d.withColumn("organ_dysfunction", C.flag(C.organ_dysfunction())).withColumn(
        out, C.flag((F.col("sirs_positive") == 1) & (F.col("organ_dysfunction") == 1)))
