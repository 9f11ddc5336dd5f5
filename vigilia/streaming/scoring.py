"""Structured Streaming operators (S1-S5): streaming DataFrame in, streaming DataFrame out.

Every operator also takes a batch DataFrame where Spark allows it (rules, windows, sessions), and the batch form is the
oracle of the stream. Event time is a TIMESTAMP column ``ts``; ``delay`` is how late a row may come.

* S1 ``score_rows``: per-row rules and alerts.
* S2 ``trends``: change and 3-row mean per patient in event-time order. Readings wait in the patient's state until the
  watermark has passed them, so a reading that comes late, in a later micro-batch, takes its place among the others; the
  state holds the last two readings of each vital and the waiting rows, nothing else, and ends when a patient has been
  without readings for ``STATE_IDLE_DAYS``. ``TREND_BUCKETS`` of patients share a call and a state entry, so a micro-batch
  makes a bounded number of Python calls, however many patients it has.
* S3 ``dedup``: duplicate readings within the watermark are dropped, older rows are dropped and counted by Spark.
* S4 ``alert_windows`` (tumbling 1 h and sliding 6 h / 1 h counts), ``stays_by_session`` (session windows per patient; a
  late row may merge two sessions). On a stream both emit a window when the watermark has passed it.
* S5 ``future_label``: left outer interval join of observations with sepsis onsets in (t, t + 6 h].

``write_epochs`` is a sink with exactly one copy of every epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import clinical as C
from ..functions import constants as K
from ..sources import tables as T


def observations(events: DataFrame, for_watermark: bool = True) -> DataFrame:
    """Observation columns of an event row (no per-patient ordinal on a stream).

    Watermarks need TIMESTAMP event time; batch forms keep TIMESTAMP_NTZ so results
    do not depend on the session time zone.
    """
    cols = [c for c in T.VITALS_COLUMNS if "hour_from_admission" not in c]
    return events.selectExpr("CAST(ts AS TIMESTAMP) AS ts" if for_watermark else "ts", *cols)


def _late(rows: DataFrame, delay: str | None) -> DataFrame:
    return rows.withWatermark("ts", delay) if delay else rows


def write_epochs(out: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: one folder per epoch, overwritten on replay, on any file system Spark writes to."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return sink


# ------------------------------------------------------------------ S1
def score_rows(obs: DataFrame) -> DataFrame:
    """S1 rules per row: SIRS, tier of the boosted score, disagreement / spike alert."""
    d = C.with_sirs(obs, keep_parts=False)
    alert = (F.col("score_b") > 0.70) | (F.abs(F.col("score_b") - F.col("score_a")) > 0.20)
    return d.select("obs_id", "patient_id", "ts", "sirs_score", "sirs_positive",
                    C.risk_tier("score_b").alias("risk_level"), alert.alias("alert"))


# ------------------------------------------------------------------ S2 (stateful)
TREND_OUT = "obs_id long, patient_id long, ts timestamp, " + ", ".join(
    f"{c}_change double, {c}_rolling_mean double" for c in K.TREND_VITALS)
TREND_IN = ["obs_id", "patient_id", "ts", *K.TREND_VITALS]
TREND_STATE = "tail binary, waiting binary"  # _TAIL of each patient; rows above the watermark (Arrow)
TREND_BUCKETS = 512  # by the patient's hash; a NULL patient has a bucket of its own
# by patient: last watermark at which rows left, and per vital the last reading and the one before
_TAIL = np.dtype([("patient", np.int64), ("at", np.int64), ("tail", np.float64, (len(K.TREND_VITALS), 2))])
STATE_IDLE_DAYS = 90
_DAY_MS = 86_400_000


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, batch.schema) as w:
            w.write_batch(batch)
        return out.getvalue().to_pybytes()


def _unpacked(blob: bytes | None) -> list[pd.DataFrame]:
    return [pa.ipc.open_stream(bytes(blob)).read_pandas()] if blob else []


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy(dtype="datetime64[us]").astype(np.int64)


def _patients(rows: pd.DataFrame) -> np.ndarray:
    """Patient of each row; rows without one come alone, as patient 0."""
    p = rows["patient_id"]
    return np.zeros(len(p), np.int64) if p.isna().all() else p.to_numpy(np.int64)


def trend_rows(rows: pd.DataFrame, first: np.ndarray, tail: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Change and 3-row mean of ``rows``, patient after patient, in order; ``first``: where each patient's rows begin;
    ``tail``: per patient and vital the reading before them and the one before that, NaN for none. Returns the rows and the
    tails after them."""
    out = {"obs_id": rows["obs_id"].to_numpy(), "patient_id": rows["patient_id"].to_numpy(), "ts": rows["ts"].to_numpy()}
    after = np.empty_like(tail)
    last = np.append(first[1:], len(rows)) - 1
    for i, c in enumerate(K.TREND_VITALS):
        v = rows[c].to_numpy(dtype=float)
        one, two = np.roll(v, 1), np.empty_like(v)
        one[first] = tail[:, i, 0]
        two[1:] = one[:-1]
        two[first] = tail[:, i, 1]
        three = np.stack([two, one, v])
        seen = (~np.isnan(three)).sum(axis=0)
        out[f"{c}_change"] = np.nan_to_num(three[2] - three[1])  # diff().fillna(0)
        out[f"{c}_rolling_mean"] = np.where(seen > 0, np.nansum(three, axis=0) / np.maximum(seen, 1), np.nan)
        after[:, i, 0], after[:, i, 1] = v[last], one[last]
    return pd.DataFrame(out), after


def _trend_state_fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One bucket of patients in one micro-batch: rows up to the watermark leave in event-time order, the others wait in the
    state.

    Frames are split one by one; what is sorted together is at most what the watermark has just passed."""
    tail, waiting = state.get if state.exists else (None, None)
    now = state.getCurrentWatermarkMs()
    due, later = [], []
    for rows in _frames(waiting, () if state.hasTimedOut else pdfs):
        rows = rows[TREND_IN]
        passed = _micros(rows["ts"]) <= now * 1000
        due.append(rows[passed])
        later.append(rows[~passed])
    known = np.frombuffer(bytes(tail), _TAIL) if tail else np.empty(0, _TAIL)  # sorted by patient
    due = [d for d in due if len(d)]
    later = [d for d in later if len(d)]
    if due:
        rows = pd.concat(due).sort_values(["patient_id", "ts", "obs_id"])
        patients, first = np.unique(_patients(rows), return_index=True)
        new = np.empty(len(patients), _TAIL)
        new["patient"], new["at"], new["tail"] = patients, now, np.nan
        _, old, place = np.intersect1d(known["patient"], patients, assume_unique=True, return_indices=True)
        new["tail"][place] = known["tail"][old]
        out, new["tail"] = trend_rows(rows, first, new["tail"])
        known = np.concatenate([np.delete(known, old), new])
        known = known[np.argsort(known["patient"], kind="stable")]
        yield out
    held = pd.concat(later) if later else None
    idle = np.ones(len(known), bool) if held is None else ~np.isin(known["patient"], _patients(held))
    over = idle & (known["at"] + STATE_IDLE_DAYS * _DAY_MS < now)  # the idle time is over
    known, idle = known[~over], idle[~over]
    if not len(known) and held is None:
        state.remove()
        return
    state.update((known.tobytes(), None if held is None else _packed(held)))
    timers = [max(int(known["at"][idle].min()) + STATE_IDLE_DAYS * _DAY_MS, now + 1)] if idle.any() else []
    if held is not None:
        timers.append(int(_micros(held["ts"]).min()) // 1000 + 1)
    state.setTimeoutTimestamp(min(timers))


def _frames(waiting: bytes | None, pdfs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _unpacked(waiting)
    yield from pdfs


def trends(obs: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Change and 3-row mean per patient of a stream of observations, rows up to ``delay`` late included.

    A row comes out once the watermark has passed it. A NULL patient is a patient."""
    bucket = F.when(F.col("patient_id").isNotNull(), F.pmod(F.xxhash64("patient_id"), F.lit(TREND_BUCKETS)).cast("int"))
    rows = _late(obs, delay).select(*TREND_IN).withColumn("bucket", bucket)
    return rows.groupBy("bucket").applyInPandasWithState(_trend_state_fn, TREND_OUT, TREND_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ S3
def dedup(events: DataFrame, key: list[str], delay: str = "2 hours") -> DataFrame:
    """S3: one reading per ``key`` within the watermark; rows older than it are dropped (and counted by Spark)."""
    return _late(events, delay).dropDuplicatesWithinWatermark(key)


# ------------------------------------------------------------------ S4 (windows)
ALERT_WINDOWS = {"1h": ("1 hour", None), "6h/1h": ("6 hours", "1 hour")}


def alert_counts(obs: DataFrame, length: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Alerts per window of ``length`` (every ``slide``; tumbling without)."""
    # the condition reads ts, so that on a stream it stays above the watermark node, which rows without an alert move too
    d = score_rows(_late(obs, delay)).filter(F.when(F.col("ts").isNotNull(), F.col("alert")))
    d = d.groupBy(F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n_alerts"))
    return d.select(F.col("w.start").alias("window_start"), "n_alerts")


def alert_windows(obs: DataFrame, delay: str | None = None) -> DataFrame:
    """Tumbling 1 h and sliding 6 h / 1 h alert counts; with ``delay`` on a stream (append mode: closed windows)."""
    tumble, slide = (alert_counts(obs, *w, delay).select(F.lit(kind).alias("kind"), "window_start", "n_alerts") for kind, w in ALERT_WINDOWS.items())
    return tumble.unionByName(slide)


def stays_by_session(obs: DataFrame, gap: str = "24 hours", delay: str | None = None) -> DataFrame:
    """Stays as session windows per patient (a new stay after ``gap`` without readings); with ``delay`` on a stream, where
    the state keeps open sessions and merges those that a late row joins."""
    return _late(obs, delay).groupBy("patient_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_obs")) \
        .select("patient_id", F.col("s.start").alias("stay_start"), F.col("s.end").alias("stay_end"), "n_obs")


# ------------------------------------------------------------------ S5 (stream-stream join)
def future_label(obs: DataFrame, onsets: DataFrame, delay: str = "6 hours", horizon_hours: int = K.HORIZON_HOURS) -> DataFrame:
    """Every observation with each sepsis onset of its patient in (t, t + 6 h] (``r_obs``, NULL without any).

    ``onsets`` (patient_id, ts, obs_id) is a second stream; both have watermarks, and a row without an onset comes out once
    the watermark has passed t + 6 h. ``label_of`` reduces the pairs to one flag per row."""
    left = _late(obs.select("obs_id", "patient_id", "ts"), delay).alias("l")
    right = onsets.select(F.col("patient_id").alias("r_pid"), F.col("ts").alias("r_ts"), F.col("obs_id").alias("r_obs")).withWatermark("r_ts", delay).alias("r")
    cond = (F.col("l.patient_id") == F.col("r.r_pid")) & (F.col("r.r_ts") > F.col("l.ts")) & \
        (F.col("r.r_ts") <= F.col("l.ts") + F.expr(f"INTERVAL {horizon_hours} HOURS"))
    return left.join(right, cond, "leftOuter").select("obs_id", "patient_id", "ts", "r_obs")


def label_of(pairs: DataFrame) -> DataFrame:
    """One row per observation with the flag of S5, from the written pairs of ``future_label``."""
    return pairs.groupBy("obs_id", "patient_id", "ts").agg(F.max(F.when(F.col("r_obs").isNotNull(), 1).otherwise(0)).alias("sepsis_next_6h_time"))


def batch_label_time(obs: DataFrame, horizon_hours: int = K.HORIZON_HOURS) -> DataFrame:
    """Batch form of S5 (interval self-join on event time), the oracle for the stream."""
    on = obs.filter(F.col("sepsis_risk_score") >= K.SEPSIS_SCORE_CUT).select(
        F.col("patient_id").alias("r_pid"), F.col("ts").alias("r_ts"))
    cond = (obs.patient_id == on.r_pid) & (on.r_ts > obs.ts) & (on.r_ts <= obs.ts + F.expr(f"INTERVAL {horizon_hours} HOURS"))
    return obs.join(on, cond, "left").groupBy("obs_id", "patient_id", "ts").agg(
        F.max(F.when(F.col("r_ts").isNotNull(), 1).otherwise(0)).alias("sepsis_next_6h_time"))
