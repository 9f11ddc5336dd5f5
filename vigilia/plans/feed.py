"""Streaming queries of the catalog: ``events`` delivered to a folder piece by piece, an operator run after each delivery.

The stand-in for a live feed: rows arrive in the order of their arrival time (event time, later for some rows), one delivery
of any number of files per slice, and a stream runs with ``availableNow`` on its checkpoint after each, as a scheduled job
would. The last two deliveries hold a heartbeat event beyond all others, so that every window, join and waiting row comes out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import ensure_checkpoint_dir
from ..sources import tables as T
from ..streaming import scoring as ST

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint"
HEARTBEAT = -1  # event id of the closing event; never in a result


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp path on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"


def deliveries(events: DataFrame, path: str, slices: int = 4, again: bool = False, late: Column | None = None, late_hours: int = 1) -> Iterator[int]:
    """Append ``events`` to ``path`` slice by slice of arrival time; yields after each delivery.

    Rows where ``late`` holds arrive ``late_hours`` after their event time. With ``again``, one more delivery repeats early
    rows and rows of the last slice (duplicates). The last deliveries are heartbeats.
    """
    spark = events.sparkSession
    arrival = F.col("ts") if late is None else F.when(late, F.col("ts") + F.expr(f"INTERVAL {late_hours} HOURS")).otherwise(F.col("ts"))
    ev = events.select("event_id", "ts", "user_id", arrival.alias("_at"))
    lo, hi, last = ev.agg(F.min("_at"), F.max("_at"), F.max("ts")).first()
    if lo is None:
        return
    span = (hi - lo) / slices
    bounds = [lo + span * i for i in range(slices)]
    parts = [ev.filter(F.col("_at") >= F.lit(a)).filter(F.col("_at") < F.lit(b)) if b is not None else ev.filter(F.col("_at") >= F.lit(a))
             for a, b in zip(bounds, [*bounds[1:], None])]
    if again:
        parts.append(parts[0].filter(F.col("event_id") % 5 == 0).unionByName(parts[-1].filter(F.col("event_id") % 7 == 0)))
    # two heartbeats: the first moves the watermark, the second's micro-batch closes what the watermark has passed
    for days in (30, 31):
        parts.append(spark.range(1).select(
            F.lit(HEARTBEAT).cast("bigint").alias("event_id"),
            (F.lit(last) + F.expr(f"INTERVAL {days} DAYS")).cast("timestamp_ntz").alias("ts"),
            F.lit(HEARTBEAT).cast("bigint").alias("user_id")))
    for i, part in enumerate(parts):
        part.select("event_id", "ts", "user_id").write.mode("append").parquet(path)
        yield i


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS_SCHEMA).parquet(path)


def run(events: DataFrame, name: str, build: Callable[[DataFrame, str], DataFrame], schema: str, **feed) -> tuple[DataFrame, list]:
    """Run ``build(event stream, source path)`` over all deliveries of ``events``; returns (written rows, all progress reports).

    Each run ends when its delivery is processed, so a run has a few micro-batches and its progress reports are complete.
    """
    spark = events.sparkSession
    path, out, ckpt = (scratch(spark, f"{name}-{x}") for x in ("events", "out", "ckpt"))
    spark.createDataFrame([], schema).write.parquet(f"{out}/epoch=-1")  # the folder and its schema exist without a batch
    progress = []
    for _ in deliveries(events, path, **feed):
        q = (build(event_stream(spark, path), path).writeStream.outputMode("append").foreachBatch(ST.write_epochs(out))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        progress += q.recentProgress
    return spark.read.schema(schema).parquet(out).drop("epoch"), progress


def ntz(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and alert every streamed observation."""
    schema = "obs_id bigint, patient_id bigint, ts timestamp, sirs_score int, sirs_positive int, risk_level string, alert boolean"
    rows, _ = run(T.table(spark, sf_dir, "events"), "s1", lambda ev, _: ST.score_rows(ST.observations(ev)), schema)
    return ntz(rows.filter(F.col("obs_id") != HEARTBEAT), "ts")


def trends(events: DataFrame, delay: str = "2 hours", **feed) -> DataFrame:
    """S2 over the deliveries of ``events``."""
    rows, _ = run(events, "s2", lambda ev, _: ST.trends(ST.observations(ev), delay), ST.TREND_OUT, **feed)
    return ntz(rows.filter(F.col("obs_id") != HEARTBEAT), "ts")


def dedup_late(spark: SparkSession, sf_dir: str, delay: str = "2 hours") -> tuple[DataFrame, int]:
    """S3: duplicate (user, ts) readings dropped within the watermark; the number of rows dropped as late."""
    def build(ev: DataFrame, _: str) -> DataFrame:
        return ST.dedup(ev.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "ts"], delay).select("event_id", "user_id", "ts")

    rows, progress = run(T.table(spark, sf_dir, "events"), "s3", build, "event_id bigint, user_id bigint, ts timestamp", again=True)
    dropped = sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in p["stateOperators"])
    return ntz(rows.filter(F.col("event_id") != HEARTBEAT), "ts"), dropped


def _without_heartbeat(obs: DataFrame) -> DataFrame:
    """The heartbeat gives no alert: its scores are NULL."""
    return obs.withColumns({c: F.when(F.col("obs_id") != HEARTBEAT, F.col(c)) for c in ("score_a", "score_b")})


def alert_windows(events: DataFrame, delay: str = "2 hours", **feed) -> DataFrame:
    """Tumbling and sliding alert counts on the stream."""
    rows, _ = run(events, "s4", lambda ev, _: ST.alert_windows(_without_heartbeat(ST.observations(ev)), delay), "kind string, window_start timestamp, n_alerts long", **feed)
    return ntz(rows, "window_start")


def stays(events: DataFrame, gap: str = "24 hours", delay: str = "36 hours", **feed) -> DataFrame:
    """Stays as session windows on the stream."""
    schema = "patient_id long, stay_start timestamp, stay_end timestamp, n_obs long"
    rows, _ = run(events, "s4s", lambda ev, _: ST.stays_by_session(ST.observations(ev), gap, delay), schema, **feed)
    return ntz(rows.filter(F.col("patient_id").isNull() | (F.col("patient_id") != HEARTBEAT)), "stay_start", "stay_end")


def label(spark: SparkSession, sf_dir: str, delay: str = "6 hours") -> DataFrame:
    """The label of every streamed observation."""
    def build(ev: DataFrame, path: str) -> DataFrame:
        seen = ST.observations(event_stream(spark, path))
        onset = (F.col("sepsis_risk_score") >= K.SEPSIS_SCORE_CUT) | (F.col("obs_id") == HEARTBEAT)
        return ST.future_label(ST.observations(ev), seen.filter(onset), delay)

    pairs, _ = run(T.table(spark, sf_dir, "events"), "s5", build, "obs_id bigint, patient_id bigint, ts timestamp, r_obs bigint")
    return ntz(ST.label_of(pairs.filter(F.col("obs_id") != HEARTBEAT)), "ts")
