"""Per-day partial aggregates of the prediction log, kept up as days are appended.

A day's partials hold one row per (patient, model, tier): count, sums and the latest prediction as a struct. They merge by
sums, by distinct keys and by the largest struct, so summaries and current risks come from the partials alone, whatever the
length of the log. After an append only the changed days are read again and only their partitions are rewritten; running it
twice changes nothing. A NULL patient, model or tier is a key like any other; rows without a time are their own day.

A history's trend compares the first and the last quarter of a patient's predictions. Days that lie in a quarter as a whole
come from the partials; of the log itself only the days that a quarter's end cuts, and the newest ones that hold the listed
predictions, are read, at most two days a patient and those of the list.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clinical as C
from . import monitor as MO
from . import sequence as S

_KEYS = ("patient_id", "model_used", "risk_level")


def day_partials(log: DataFrame) -> DataFrame:
    """(dt, patient, model, tier): count, sums and latest prediction of a log with the day column ``dt``."""
    return log.groupBy("dt", *_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("sum_risk"), F.count("risk_score").alias("n_risk"),
        F.sum("confidence").alias("sum_confidence"), F.count("confidence").alias("n_confidence"),
        F.max(F.struct("ts", "obs_id", "risk_score")).alias("latest"))


def refresh(spark: SparkSession, log_path: str, partial_path: str, days: Sequence[datetime.date | None]) -> None:
    """Rewrite the partials of ``days`` from the log's partitions of these days; other days are neither read nor written."""
    known = [d for d in days if d is not None]
    changed = F.col("dt").isin(known) if known else F.lit(False)
    if None in days:
        changed = changed | F.col("dt").isNull()
    rows = day_partials(spark.read.parquet(log_path).filter(changed))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(partial_path)


def append_day(log: DataFrame, log_path: str, partial_path: str) -> list:
    """Append rows to the log and bring the partials of their days up to date; returns these days."""
    from ..sources.io import append_predictions
    days = [r[0] for r in log.select(F.to_date("ts").alias("dt")).distinct().collect()]  # one row per appended day
    append_predictions(log, log_path)
    refresh(log.sparkSession, log_path, partial_path, days)
    return days


def summary(partials: DataFrame) -> DataFrame:
    """D13 from the partials: the rows of ``monitor.system_summary`` over the whole log."""
    last = partials.agg(F.max("dt")).scalar()
    total = partials.agg(F.sum("n")).scalar()
    # one row per key first: the distinct patients of the cube are then counted over patients, not predictions
    keys = partials.groupBy(*_KEYS).agg(F.sum(F.when(F.col("dt") == last, F.col("n")).otherwise(0)).alias("n_today"),
                                        *[F.sum(c).alias(c) for c in ("n", "sum_risk", "n_risk", "sum_confidence", "n_confidence")])
    c = keys.cube("model_used", "risk_level").agg(
        F.sum("n").alias("n_predictions"), F.countDistinct("patient_id").alias("n_patients"), F.sum("n_today").alias("n_today"),
        F.round(F.sum("sum_risk") / F.sum("n_risk"), 6).alias("avg_risk_score"),
        F.round(F.sum("sum_confidence") / F.sum("n_confidence"), 6).alias("avg_confidence"), F.grouping_id().alias("_g"))
    return c.select(
        F.when(F.col("_g") >= 2, "ALL").otherwise(F.col("model_used")).alias("model_used"),
        F.when(F.col("_g") % 2 == 1, "ALL").otherwise(F.col("risk_level")).alias("risk_level"),
        "n_predictions", "n_patients", "n_today", "avg_risk_score", "avg_confidence",
        F.round(F.col("n_predictions") * 100.0 / total, 6).alias("pct_of_all"))


def current_risk(partials: DataFrame) -> DataFrame:
    """N5 from the partials: the rows of ``monitor.current_risk`` over the whole log."""
    last = partials.groupBy("patient_id").agg(F.max("latest").alias("_l"))
    return last.select("patient_id", F.col("_l.risk_score").alias("current_risk_score"),
                       C.risk_tier(F.col("_l.risk_score")).alias("current_risk_level"), F.col("_l.ts").alias("last_updated"))


def history_days(partials: DataFrame, keep_last: int = 24) -> DataFrame:
    """(patient, dt) of the partials with the day's place in the patient's series: rows before it (``lo``) and up to its end
    (``hi``), rows in all (``_n``), sums, the latest prediction, and ``in_log``: whether its rows are needed one by one."""
    day = partials.groupBy("patient_id", "dt").agg(
        F.sum("n").alias("n"), F.sum("sum_risk").alias("sum_risk"), F.sum("n_risk").alias("n_risk"), F.max("latest").alias("latest"))
    one = Window.partitionBy("patient_id")  # a row per day of the patient
    day = day.withColumns({"hi": F.sum("n").over(one.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("n").over(one)})
    lo, hi, end, q = F.col("hi") - F.col("n"), F.col("hi"), F.col("_n"), F.floor(F.col("_n") / 4)
    cut = ((lo < q) & (hi > q)) | ((lo < end - q) & (hi > end - q))
    return day.withColumns({"lo": lo, "in_log": cut | (hi > end - keep_last)})


def history(partials: DataFrame, log: DataFrame, keep_last: int = 24, hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """N4 from the partials and the log with its day column ``dt``: the rows of ``monitor.patient_history`` over the whole log."""
    days = history_days(partials, keep_last)
    q = F.floor(F.col("_n") / 4)
    first, last = F.col("hi") <= q, F.col("lo") >= F.col("_n") - q
    one = "struct<ts:timestamp_ntz,obs_id:bigint,model_used:string,risk_score:double,risk_level:string>"
    whole = days.select("patient_id", "_n", "latest", F.lit(None).cast(one).alias("one"),
                        *[F.when(side, F.col(c)).alias(f"{c}_{name}") for name, side in (("first", first), ("last", last)) for c in ("sum_risk", "n_risk")])

    pair = F.to_json(F.struct("patient_id", "dt"), {"ignoreNullFields": "false"})
    needed = days.filter("in_log").select(pair.alias("pair"), "lo", "hi", "_n")
    rows = log.select("patient_id", "dt", "ts", "obs_id", "model_used", "risk_score", "risk_level").withColumn("pair", pair)
    rows = rows.join(needed.select("pair"), "pair", "left_semi")
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    rows = S.ordinal_within(rows, "pair", ["ts", "obs_id"], "at", chunk_basis=hours, hot_rows=hot_rows).join(needed, "pair")
    r = F.col("lo") + F.col("at")
    picked = [(n, side & ~full) for n, side, full in (("first", r < q, first), ("last", r >= F.col("_n") - q, last))]
    single = rows.select("patient_id", F.lit(None).cast("long").alias("_n"), F.lit(None).cast(days.schema["latest"].dataType).alias("latest"),
                         F.when(r >= F.col("_n") - keep_last, F.struct("ts", "obs_id", "model_used", "risk_score", "risk_level").cast(one)).alias("one"),
                         *[F.when(side, v).alias(f"{c}_{n}") for n, side in picked
                           for c, v in (("sum_risk", F.col("risk_score")), ("n_risk", F.col("risk_score").isNotNull().cast("long")))])
    g = whole.unionByName(single).groupBy("patient_id").agg(
        F.max("_n").alias("n_points"), F.max("latest").alias("_l"), F.sort_array(F.collect_list("one")).alias("predictions"),
        *[F.try_divide(F.sum(f"sum_risk_{n}"), F.sum(f"n_risk_{n}")).alias(f"_{n}") for n in ("first", "last")])
    return g.select("patient_id", "predictions", F.col("_l.risk_score").alias("current_risk_score"),
                    C.risk_tier(F.col("_l.risk_score")).alias("current_risk_level"), F.col("_l.ts").alias("last_updated"),
                    MO.trend_label().alias("trend"), "n_points")
