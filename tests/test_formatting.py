"""The JVM-side formatter must print exactly what Python prints (ties, negatives, -0.0)."""

import random

from pyspark.sql import functions as F

from vigilia.functions.fmt import fmt_fixed, fmt_pct


def test_fixed_and_percent_match_python(spark):
    random.seed(7)
    vals = ([k / 1000 for k in range(-300, 1300, 7)] + [k / 8 for k in range(-20, 20)] + [0.125, 0.165, 2.675, -0.0,
            0.0, 1e-7, -1e-7, 0.0078125] + [random.uniform(-500, 500) for _ in range(400)])
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = df.select("x", fmt_fixed(F.col("x"), 2).alias("f2"), fmt_fixed(F.col("x"), 4, plus=True).alias("p4"),
                    fmt_fixed(F.col("x"), 0).alias("f0"), fmt_pct(F.col("x"), 1).alias("pc")).collect()
    for r in out:
        assert r.f2 == "%.2f" % r.x
        assert r.p4 == "%+.4f" % r.x
        assert r.f0 == "%.0f" % r.x
        assert r.pc == "{:.1%}".format(r.x)
