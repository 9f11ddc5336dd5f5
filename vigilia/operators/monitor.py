"""Monitoring, history and summaries over score series and prediction logs.

Per-patient series work uses the skew-safe ordinal (``sequence``), per-patient
counts from a partial aggregation, and grouped conditional means; arrays kept
per patient are bounded top-k lists, never a whole history.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import constants as K
from ..functions.fmt import fmt_fixed
from . import sequence as S


def ensemble_series(df: DataFrame | None = None, rf: str = "score_a", xgb: str = "score_b") -> Column:
    """The .4 / .6 ensemble of the two model scores."""
    return F.lit(K.ENSEMBLE_RF_WEIGHT) * F.col(rf) + F.lit(K.ENSEMBLE_XGB_WEIGHT) * F.col(xgb)


def with_position(df: DataFrame, key: str = "patient_id", order: tuple[str, ...] = ("hour_from_admission", "obs_id"),
                  hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """0-based position ``_r`` in time order and series length ``_n`` per key."""
    return S.ordinal_within(df, key, list(order), "_r", chunk_basis=F.col(order[0]), hot_rows=hot_rows, length="_n")


def _trend_of(value: str) -> list[Column]:
    """Aggregates of a trend: number of points, mean of the first and of the last quarter."""
    q = F.floor(F.col("_n") / 4)
    return [F.first("_n").alias("n_points"), F.avg(F.when(F.col("_r") < q, F.col(value))).alias("_first"),
            F.avg(F.when(F.col("_r") >= F.col("_n") - q, F.col(value))).alias("_last")]


def trend_label() -> Column:
    diff = F.col("_last") - F.col("_first")
    return F.when(F.col("n_points") < 4, "stable").when(diff > 0.05, "declining").when(diff < -0.05, "improving").otherwise("stable")


def _trend_delta(digits: int = 6) -> Column:
    return F.when(F.col("n_points") >= 4, F.round(F.col("_last") - F.col("_first"), digits))


def trend(df: DataFrame, value: str, key: str = "patient_id", digits: int = 6) -> DataFrame:
    """q = n // 4; mean(last q) - mean(first q); > .05 declining, < -.05 improving, else stable.

    ``df`` must carry ``_r`` (position) and ``_n`` (length), see :func:`with_position`. A NULL patient is a patient.
    """
    g = df.groupBy(key).agg(*_trend_of(value))
    return g.select(key, "n_points", _trend_delta(digits).alias("trend_delta"), trend_label().alias("trend"))


def spike_alert(rf: Column, xgb: Column, hours_before: Column) -> tuple[Column, Column]:
    """Boosted score > .70 -> high-risk alert, else |gap| > .20 -> divergence alert, with message."""
    t = F.concat(F.lit("t-"), hours_before.cast("string"), F.lit("h"))
    high = xgb > 0.70
    div = F.abs(xgb - rf) > 0.20
    msg = (F.when(high, F.concat(F.lit("XGBoost detects HIGH risk ("), fmt_fixed(xgb, 2), F.lit(") at "), t,
                                 F.lit(" — immediate review")))
           .when(div, F.concat(F.lit("Model divergence detected at "), t, F.lit(" (RF="), fmt_fixed(rf, 2),
                               F.lit(", XGB="), fmt_fixed(xgb, 2), F.lit(")"))))
    return (high | div), msg


def series_points(df: DataFrame, rf: str = "score_a", xgb: str = "score_b") -> DataFrame:
    """N3 point rows: ensemble, tier, alert flag and message (needs ``_r`` / ``_n``)."""
    h = (F.col("_n") - F.col("_r")).cast("long")
    flag, msg = spike_alert(F.col(rf), F.col(xgb), h)
    ens = ensemble_series(df, rf, xgb)
    return df.withColumns({"hours_before": h, "ensemble_score": ens, "risk_level": C.risk_tier(ens),
                           "alert_triggered": flag, "alert_message": msg})


def monitoring_summary(v: DataFrame, hours: int = 24, key: str = "patient_id",
                       hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """Per patient over the last ``hours`` points: count, trend of the ensemble score, and the alert list
    (time and message of each alert, oldest first; at most ``hours`` entries)."""
    last = S.top_k_per_key(v, key, [F.col("hour_from_admission").desc(), F.col("obs_id").desc()], hours,
                           chunk_basis=F.col("hour_from_admission"), hot_rows=hot_rows)
    # rank 1 = latest; position from the oldest of the window (at most ``hours`` rows a patient)
    pts = last.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn("_r", F.col("_n") - F.col("rank"))
    pts = series_points(pts)
    one = F.struct("_r", F.concat(F.lit("-"), F.col("hours_before").cast("string"), F.lit("h")).alias("time"),
                   F.col("alert_message").alias("message"))
    g = pts.groupBy(key).agg(*_trend_of("ensemble_score"), F.sum(F.col("alert_triggered").cast("int")).cast("long").alias("total_alerts"),
                             F.sort_array(F.collect_list(F.when(F.col("alert_triggered"), one))).alias("alerts"))
    return g.select(key, F.col("n_points").alias("total_data_points"), "total_alerts", trend_label().alias("trend"),
                    _trend_delta().alias("trend_delta"), F.transform("alerts", lambda a: F.struct(a["time"], a["message"])).alias("alerts"))


def current_risk(log: DataFrame, key: str = "patient_id") -> DataFrame:
    """Latest logged score per patient (as-of with ``max_by``, partial aggregation) and its tier."""
    last = log.groupBy(key).agg(F.max_by(F.struct("risk_score", "ts", "obs_id"), F.struct("ts", "obs_id")).alias("_l"),
                                F.max("ts").alias("last_updated"))
    return last.select(key, F.col("_l.risk_score").alias("current_risk_score"),
                       C.risk_tier(F.col("_l.risk_score")).alias("current_risk_level"), "last_updated")


def patient_history(log: DataFrame, key: str = "patient_id", keep_last: int = 24,
                    hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """Recent predictions (bounded list), current risk, trend over all predictions, last update."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    pos = with_position(log.withColumn("_t_hours", hours), key, ("_t_hours", "obs_id"), hot_rows)
    one = F.struct("ts", "obs_id", "model_used", "risk_score", "risk_level")
    g = pos.groupBy(key).agg(*_trend_of("risk_score"), F.sort_array(F.collect_list(F.when(F.col("_r") >= F.col("_n") - keep_last, one))).alias("predictions"),
                             F.max_by(F.struct("risk_score", "ts", "obs_id"), F.struct("ts", "obs_id")).alias("_l"), F.max("ts").alias("last_updated"))
    return g.select(key, "predictions", F.col("_l.risk_score").alias("current_risk_score"), C.risk_tier(F.col("_l.risk_score")).alias("current_risk_level"),
                    "last_updated", trend_label().alias("trend"), "n_points")


def history_rows(log: DataFrame, key: str = "patient_id", hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """Every prediction of every patient with its number in time order (rows, so that no patient's
    whole history has to fit one array)."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    d = S.ordinal_within(log, key, ["ts", "obs_id"], "seq", chunk_basis=hours, hot_rows=hot_rows)
    return d.select(key, (F.col("seq") + 1).alias("seq"), "obs_id", "ts", "model_used", "risk_score", "risk_level")


def system_summary(log: DataFrame) -> DataFrame:
    """Predictions, patients, average risk and confidence by model and tier, all levels at once (CUBE).

    'Today' is the latest calendar day in the log.
    """
    today = log.agg(F.max(F.to_date("ts"))).scalar()
    c = log.cube("model_used", "risk_level").agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.countDistinct("patient_id").alias("n_patients"),
        F.sum(F.when(F.to_date("ts") == today, 1).otherwise(0)).cast("long").alias("n_today"),
        F.round(F.avg("risk_score"), 6).alias("avg_risk_score"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.grouping_id().alias("_g"),
    )
    total = log.agg(F.count(F.lit(1))).scalar()
    return c.select(
        F.when(F.col("_g") >= 2, "ALL").otherwise(F.col("model_used")).alias("model_used"),
        F.when(F.col("_g") % 2 == 1, "ALL").otherwise(F.col("risk_level")).alias("risk_level"),
        "n_predictions", "n_patients", "n_today", "avg_risk_score", "avg_confidence",
        F.round(F.col("n_predictions") * 100.0 / total, 6).alias("pct_of_all"))


def metrics_with_defaults(computed_long: DataFrame, models: list[str]) -> DataFrame:
    """A10: per model and metric the computed value, or the interface default when none exists."""
    spark = computed_long.sparkSession
    defaults = spark.createDataFrame([(m, k, v) for m in models for k, v in K.DEFAULT_MODEL_METRICS.items()],
                                     "model string, metric string, default_value double")
    j = defaults.join(computed_long, on=["model", "metric"], how="left")
    return j.select("model", "metric", F.coalesce("value", "default_value").alias("value"),
                    F.when(F.col("value").isNotNull(), "computed").otherwise("default").alias("source"))


def metrics_from_files(spark: SparkSession, folder: str, models: list[str]) -> DataFrame:
    """A10: (model, metric, value, source) per model from ``<folder>/<model>_metrics.json`` (a file, or a folder that Spark wrote).

    A model whose file holds a JSON object of numbers has exactly these metrics; one without a file, or with a broken one, has
    the interface defaults.
    """
    defaults = spark.createDataFrame([(m, k, v) for m in models for k, v in K.DEFAULT_MODEL_METRICS.items()], "model string, metric string, value double")
    try:
        files = spark.read.text(f"{folder.rstrip('/')}/*_metrics.json", wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return defaults.withColumn("source", F.lit("default"))
    model = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_metrics\.json(/[^/]*)?$", 1)
    held = files.select(model.alias("model"), F.explode(F.from_json("value", "map<string,double>")).alias("metric", "value"))
    held = held.filter(F.col("model").isin(models) & F.col("value").isNotNull())
    missing = defaults.join(held.select("model").distinct(), "model", "left_anti")
    return held.withColumn("source", F.lit("file")).unionByName(missing.withColumn("source", F.lit("default")))
