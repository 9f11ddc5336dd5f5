"""Values that the SQL oracles expect, typed here independently of ``functions.constants``.

The rules never read this module and the oracles of ranges, clips and threshold grids read only this
one, so a wrong value on either side shows as a mismatch.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# parameter, low, high, unit, range text
RANGES = [
    ("lactate", 0.5, 2.0, "mmol/L", "0.5-2.0"),
    ("wbc_count", 4.0, 11.0, "x10^9/L", "4.0-11.0"),
    ("crp_level", 0.0, 10.0, "mg/L", "0-10"),
    ("creatinine", 0.6, 1.2, "mg/dL", "0.6-1.2"),
    ("heart_rate", 60.0, 100.0, "bpm", "60-100"),
    ("respiratory_rate", 12.0, 20.0, "/min", "12-20"),
    ("temperature_c", 36.5, 37.5, "C", "36.5-37.5"),
    ("systolic_bp", 90.0, 140.0, "mmHg", "90-140"),
    ("diastolic_bp", 60.0, 90.0, "mmHg", "60-90"),
    ("spo2_pct", 95.0, 100.0, "%", "95-100"),
    ("hemoglobin", 12.0, 17.5, "g/dL", "12.0-17.5"),
]
SCRIPT_UNITS = {"temperature_c": "°C"}  # units that the script's table writes in another way
# lowest and highest plausible value
CLIPS = {
    "heart_rate": (30.0, 220.0), "respiratory_rate": (5.0, 60.0), "spo2_pct": (50.0, 100.0), "temperature_c": (34.0, 42.0),
    "systolic_bp": (50.0, 250.0), "diastolic_bp": (30.0, 150.0), "wbc_count": (0.5, 40.0), "lactate": (0.2, 20.0),
    "creatinine": (0.2, 15.0), "crp_level": (0.0, 50.0), "hemoglobin": (4.0, 20.0),
}
# request fields that are named otherwise than the parameter, and range texts with units by request field
REQUEST_NAMES = {"temperature_c": "temperature", "spo2_pct": "spo2"}
REQUEST_RANGES = {
    "lactate": "0.5-2.0 mmol/L", "wbc_count": "4.0-11.0 x10^9/L", "crp_level": "0.0-10.0 mg/L", "creatinine": "0.6-1.2 mg/dL",
    "heart_rate": "60-100 bpm", "respiratory_rate": "12-20 /min", "temperature": "36.5-37.5 °C", "spo2": "95-100 %",
    "systolic_bp": "90-140 mmHg", "diastolic_bp": "60-90 mmHg", "hemoglobin": "12.0-17.5 g/dL",
}
REQUEST_ORDER = ["lactate", "wbc_count", "crp_level", "creatinine", "heart_rate", "respiratory_rate", "temperature", "spo2",
                 "systolic_bp", "diastolic_bp", "hemoglobin"]
# lower cuts of the risk tiers, and the metrics shown for a model without a metrics file
RISK_CUTS = {"moderate": 0.5, "high": 0.7, "critical": 0.85}
MODEL_METRICS = {"accuracy": 0.87, "sensitivity": 0.85, "specificity": 0.89, "auc_roc": 0.91, "f1_score": 0.86, "precision": 0.88}
# threshold grids in hundredths: first, last, step
GRIDS = {"g30_59_by1": (30, 59, 1), "g30_68_by2": (30, 68, 2), "g10_85_by5": (10, 85, 5), "g20_88_by2": (20, 88, 2), "g30_69_by1": (30, 69, 1)}
# ------------------------------------------------------------ end FIXED VALUES
