"""Queries: sources, per-row rules, labels, windows and features (A, B, C3, E, I)."""

from __future__ import annotations


from ..functions import clinical as C
from ..operators import labels as L
from ..sources import tables as T
from . import slice as SL
from .registry import query
from .sqlbase import with_views as W


def V(spark, sf):
    return T.vitals(spark, sf)


@query("slice_sepsis_share_by_sirs", W("lab") + SL.SQL)
def q_slice(spark, sf):
    """Minimum slice: share of patient-hours followed by sepsis within 6 h, by SIRS score."""
    return SL.sepsis_share_by_sirs(V(spark, sf))


@query("a1_vitals_view", W("vitals") + "SELECT * FROM vitals")
def q_vitals(spark, sf):
    """Observation table (typed scan of events + fixed mapping), all 27 columns."""
    return V(spark, sf)


@query("b1_sirs_flags", W("sv") + "SELECT obs_id, sirs_temp, sirs_hr, sirs_rr, sirs_wbc FROM sv")
def q_b1(spark, sf):
    """B1: four strict SIRS flags; NULL reading gives 0."""
    return C.with_sirs(V(spark, sf)).select("obs_id", "sirs_temp", "sirs_hr", "sirs_rr", "sirs_wbc")


@query("b2_sirs_score", W("sv") + "SELECT obs_id, sirs_score, sirs_positive FROM sv")
def q_b2(spark, sf):
    """B2: SIRS score 0-4 and positive flag (>= 2)."""
    return C.with_sirs(V(spark, sf)).select("obs_id", "sirs_score", "sirs_positive")


@query("e3_label_future_sepsis", W("lab") + """SELECT obs_id, patient_id, hour_from_admission, sepsis, sepsis_next_6h
FROM lab""")
def q_e3(spark, sf):
    """B5 + E3: current sepsis and label A (any sepsis in the next 6 hours of the same patient)."""
    return L.label_future_sepsis(V(spark, sf)).select("obs_id", "patient_id", "hour_from_admission",
                                                       "sepsis", "sepsis_next_6h")
