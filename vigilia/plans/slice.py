"""Minimum slice: by SIRS score, what share of patient-hours is followed by sepsis within 6 hours?

events -> vitals -> SIRS (B1, B2) -> current sepsis (B5) -> label A (E3) -> positives by score (D3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..operators import labels
from ..operators import sequence as S


def sepsis_share_by_sirs(v: DataFrame, hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    lab = labels.label_future_sepsis(C.with_sirs(v, keep_parts=False), hot_rows=hot_rows)
    return (lab.groupBy("sirs_score")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum("sepsis_next_6h").cast("long").alias("n_positive"),
                 F.round(F.avg("sepsis_next_6h") * 100, 6).alias("positive_pct")))


SQL = """SELECT sirs_score, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(sepsis_next_6h) AS BIGINT) AS n_positive,
  ROUND(AVG(sepsis_next_6h) * 100, 6) AS positive_pct
FROM lab GROUP BY sirs_score"""
