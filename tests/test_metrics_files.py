"""A10: metrics files per model; a broken or absent file gives the defaults."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from vigilia.functions import constants as K
from vigilia.operators import explain as X
from vigilia.operators import monitor as MO
from vigilia.operators import profile as P


def test_files_defaults_and_broken_files(spark):
    folder = tempfile.mkdtemp(prefix="vigilia-metrics-")
    default = {k: (v, "default") for k, v in K.DEFAULT_MODEL_METRICS.items()}
    read = lambda f: {m: {r.metric: (r.value, r.source) for r in MO.metrics_from_files(spark, f, ["a", "b", "c"]).collect() if r.model == m} for m in "abc"}
    assert read(folder) == read(f"{folder}/none") == {m: default for m in "abc"}
    for name, text in (("a", json.dumps({"accuracy": 0.5, "own": 2}, indent=1)), ("b", "{broken"), ("other", "{}")):
        with open(os.path.join(folder, f"{name}_metrics.json"), "w") as f:
            f.write(text)
    assert read(folder) == {"a": {"accuracy": (0.5, "file"), "own": (2.0, "file")}, "b": default, "c": default}


def test_leakage_report_and_report_names(spark):
    rows = [(i % 2, float(i % 2) * 3 + 0.001 * i, float(i % 7), None, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "y int, twin double, other double, empty double, sepsis_risk_score double")
    got = {(r.feature, r.reason) for r in P.leakage_report(df, "y", ["twin", "other", "empty", "sepsis_risk_score"]).collect()}
    assert got == {("twin", "correlation"), ("sepsis_risk_score", "name")}
    r = spark.range(1).select(X.report_name(F.col("id"), F.lit("2024-03-01 04:05:06").cast("timestamp_ntz")), X.report_name(F.col("id"))).first()
    assert r[0] == "reports/sepsis_report_0_20240301_040506.pdf" and len(r[1]) == len(r[0])
