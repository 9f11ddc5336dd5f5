"""E-A preparation job: observations -> labelled feature table -> splits on disk.

One Exchange on the patient key serves the label (RANGE frame) and the trend
features (ROWS frames): both are evaluated in the same per-patient sorted
partition; hot patients take the chunked path of ``sequence_windows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import constants as K
from ..operators import features as FE
from ..operators import sequence as S
from ..operators import split as SP


def prepared_table(v: DataFrame, *, horizon: int = K.HORIZON_HOURS, hot_rows: int | None = S.HOT_ROWS,
                   key: str = "patient_id", hour: str = "hour_from_admission", drop_leakage: bool = True) -> DataFrame:
    """Label A + SIRS + change / rolling features + all-level one-hot; leakage columns dropped."""
    d = C.with_sirs(v).withColumn("sepsis", C.sepsis_now())

    def rng(x: DataFrame, parts: list) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(F.col(hour)).rangeBetween(1, horizon)
        return x.withColumn("sepsis_next_6h", F.coalesce(F.max("sepsis").over(w), F.lit(0)))

    def rows(x: DataFrame, parts: list) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(F.col(hour), F.col("obs_id"))
        adds = {}
        for c in K.TREND_VITALS:
            adds[f"{c}_change"] = F.coalesce(F.col(c) - F.lag(c, 1).over(w), F.lit(0.0))
            adds[f"{c}_rolling_mean"] = F.avg(c).over(w.rowsBetween(-2, 0))
        return x.withColumns(adds)

    d = S.sequence_windows(d, key, [hour, "obs_id"], chunk_basis=F.col(hour), range_fn=rng, rows_fn=rows,
                           range_fwd=horizon, rows_back=2, hot_rows=hot_rows)
    d = FE.one_hot(d)
    return FE.drop_present(d, [c for c in K.LEAKAGE_DROP if c != "patient_id"]) if drop_leakage else d


def write_splits(prepared: DataFrame, path: str, label: str = "sepsis_next_6h", mode: str = "overwrite") -> None:
    """A5: stratified 70/15/15 split written once, partitioned by ``split`` (readers prune to one split)."""
    d = prepared.withColumn("_h", SP.id_hash("obs_id"))
    d = SP.stratified_split(d, label, ["_h", "obs_id"]).drop("_h")
    d.write.mode(mode).partitionBy("split").parquet(path)
