"""Stream results equal batch results on the same rows (SURVEY §5 property 'stream = batch')."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from paths import SF_SMALL
from vigilia.functions import constants as K
from vigilia.operators import features as FE
from vigilia.plans import feed
from vigilia.sources import tables as T
from vigilia.streaming import scoring as ST


def test_stream_scores_equal_batch(spark):
    s = feed.scores(spark, SF_SMALL)
    b = ST.score_rows(ST.observations(T.table(spark, SF_SMALL, "events"), for_watermark=False))
    assert s.count() == 1000 and s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_stateful_trends_equal_batch_windows(spark):
    cols = [f"{c}_change" for c in K.TREND_VITALS] + [f"{c}_rolling_mean" for c in K.TREND_VITALS]
    a = feed.trends(T.table(spark, SF_SMALL, "events"), late=F.col("event_id") % 3 == 0).select("obs_id", *cols).toPandas().sort_values("obs_id")
    b = FE.trend_features(T.vitals(spark, SF_SMALL)).select("obs_id", *cols).toPandas().sort_values("obs_id")
    assert len(a) == len(b) == 1000
    assert np.allclose(a.fillna(-9).to_numpy(), b.fillna(-9).to_numpy())


def test_dedup_drops_and_counts_late_and_duplicate_rows(spark):
    rows, late = feed.dedup_late(spark, SF_SMALL)
    assert rows.count() == rows.select("user_id", "ts").distinct().count() == 1000
    ev = T.table(spark, SF_SMALL, "events")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    again = ev.filter(((F.col("ts") < F.lit(lo + (hi - lo) / 4)) & (F.col("event_id") % 5 == 0))
                      | ((F.col("ts") >= F.lit(lo + (hi - lo) / 4 * 3)) & (F.col("event_id") % 7 == 0)))
    assert late == again.filter(F.col("ts") <= F.lit(hi - datetime.timedelta(hours=2))).count() > 0


def test_stream_label_equals_batch(spark):
    s = feed.label(spark, SF_SMALL)
    b = ST.batch_label_time(ST.observations(T.table(spark, SF_SMALL, "events"), for_watermark=False))
    assert s.count() == 1000 and s.exceptAll(b).count() == 0


def test_stream_windows_are_complete(spark):
    ev = T.table(spark, SF_SMALL, "events")
    s = feed.alert_windows(ev, late=F.col("event_id") % 3 == 0)
    b = ST.alert_windows(ST.observations(ev, for_watermark=False))
    assert s.count() == b.count() > 0 and s.exceptAll(b).count() == 0
    assert {r[0] for r in s.select("kind").distinct().collect()} == {"1h", "6h/1h"}


def _events(spark, rows):
    """(event_id, hour, patient) as an events table."""
    day = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, day + datetime.timedelta(hours=h), p) for i, h, p in rows], feed.EVENTS_SCHEMA)


def test_late_rows_take_their_place_in_the_trend(spark):
    # hours 0..39 of two patients and a NULL patient; every fourth row comes 3 h late, in a later of 8 deliveries
    ev = _events(spark, [(100 * k + h, float(h), p) for k, p in enumerate((1, 2, None)) for h in range(40)])
    late = F.col("event_id") % 4 == 0
    cols = [f"{c}_change" for c in K.TREND_VITALS] + [f"{c}_rolling_mean" for c in K.TREND_VITALS]
    a = feed.trends(ev, "4 hours", slices=8, late=late, late_hours=3).select("obs_id", *cols).toPandas().sort_values("obs_id")
    w = Window.partitionBy("patient_id").orderBy("ts", "obs_id")
    obs = ST.observations(ev, for_watermark=False)
    b = obs.select("obs_id", *[F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)).alias(f"{c}_change") for c in K.TREND_VITALS],
                   *[F.avg(c).over(w.rowsBetween(-2, 0)).alias(f"{c}_rolling_mean") for c in K.TREND_VITALS]).toPandas().sort_values("obs_id")
    assert a["obs_id"].tolist() == b["obs_id"].tolist()
    assert np.allclose(a.fillna(-9).to_numpy(dtype=float), b.fillna(-9).to_numpy(dtype=float))


class _State:
    """A patient's state as Spark hands it to the function."""

    def __init__(self):
        self.value, self.watermark, self.hasTimedOut, self.timer = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):
        assert ms > self.watermark
        self.timer = ms


def _readings(hours):
    ts = pd.to_datetime([f"2024-01-01T{h:02d}:00:00" for h in hours])
    return pd.DataFrame({"obs_id": hours, "patient_id": 7, "ts": ts, **{c: [float(h) for h in hours] for c in K.TREND_VITALS}})


def test_state_holds_only_rows_above_the_watermark():
    state, hour = _State(), lambda h: int(pd.Timestamp(f"2024-01-01T{h:02d}:00:00").timestamp() * 1000)
    assert list(ST._trend_state_fn((7,), iter([_readings([1, 5]), _readings([3])]), state)) == []
    assert sum(map(len, ST._unpacked(state.value[1]))) == 3 and state.timer == hour(1) + 1
    state.watermark = hour(4)
    out = pd.concat(ST._trend_state_fn((7,), iter([_readings([2, 6])]), state))  # 2 is late, but above the last watermark
    c = K.TREND_VITALS[0]
    assert out["obs_id"].tolist() == [1, 2, 3] and out[f"{c}_change"].tolist() == [0, 1, 1] and out[f"{c}_rolling_mean"].tolist() == [1, 1.5, 2]
    assert sorted(x for d in ST._unpacked(state.value[1]) for x in d["obs_id"]) == [5, 6] and state.timer == hour(5) + 1
    state.watermark, state.hasTimedOut = hour(10), True
    out = pd.concat(ST._trend_state_fn((7,), iter([]), state))
    assert out["obs_id"].tolist() == [5, 6] and out[f"{c}_change"].tolist() == [2, 1] and state.value[1] is None
    state.watermark = state.timer + 1
    assert list(ST._trend_state_fn((7,), iter([]), state)) == [] and not state.exists


def test_a_late_row_joins_two_sessions(spark):
    # hours 0 and 40 are two stays until the row of hour 20 arrives, 30 h late; patient 2 keeps two stays
    ev = _events(spark, [(1, 0.0, 1), (2, 40.0, 1), (3, 20.0, 1), (4, 0.0, 2), (5, 60.0, 2), (6, 59.0, None), (7, 100.0, 3)])
    s = feed.stays(ev, "24 hours", "36 hours", slices=6, late=F.col("event_id") == 3, late_hours=30)
    b = ST.stays_by_session(ST.observations(ev, for_watermark=False))
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
    assert s.filter("patient_id = 1").count() == 1 and s.filter("patient_id = 2").count() == 2
    ev = T.table(spark, SF_SMALL, "events")
    s = feed.stays(ev, late=F.col("event_id") % 7 == 0, late_hours=30)
    b = ST.stays_by_session(ST.observations(ev, for_watermark=False))
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_a_bucket_keeps_its_patients_apart():
    c = K.TREND_VITALS[0]
    big = (1 << 60) + 1  # an id that a double does not hold

    def rows(patient, hours):
        return _readings(hours).assign(patient_id=np.int64(patient))

    state, hour = _State(), lambda h: int(pd.Timestamp(f"2024-01-01T{h:02d}:00:00").timestamp() * 1000)
    state.watermark = hour(4)
    out = pd.concat(ST._trend_state_fn((0,), iter([rows(big, [3, 1]), rows(5, [2, 4, 9])]), state))
    got = {p: g.sort_values("obs_id") for p, g in out.groupby("patient_id")}
    assert got[big]["obs_id"].tolist() == [1, 3] and got[big][f"{c}_change"].tolist() == [0, 2]
    assert got[5]["obs_id"].tolist() == [2, 4] and got[5][f"{c}_rolling_mean"].tolist() == [2, 3] and state.timer == hour(9) + 1
    state.watermark = hour(12)
    out = pd.concat(ST._trend_state_fn((0,), iter([rows(big, [7, 12]), rows(6, [11])]), state))
    got = {p: g for p, g in out.groupby("patient_id")}
    assert got[big][f"{c}_change"].tolist() == [4, 5] and got[big][f"{c}_rolling_mean"].tolist() == [11 / 3, 22 / 3]
    assert got[5][f"{c}_change"].tolist() == [5] and got[6][f"{c}_change"].tolist() == [0] and state.value[1] is None
    # patient 5 is without readings for the idle time, big is not
    state.watermark = hour(12) + 1
    assert list(ST._trend_state_fn((0,), iter([rows(big, [13])]), state)) == []
    state.watermark = hour(12) + ST.STATE_IDLE_DAYS * ST._DAY_MS + 1
    state.hasTimedOut = True
    out = pd.concat(ST._trend_state_fn((0,), iter([]), state))
    assert out[f"{c}_change"].tolist() == [1] and np.frombuffer(state.value[0], ST._TAIL)["patient"].tolist() == [big]


def test_trends_call_python_for_a_bounded_number_of_groups(spark):
    ev = spark.range(4000).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 60) AS ts", "id AS user_id")
    path = feed.scratch(spark, "s2-buckets")
    ev.select("event_id", "ts", "user_id").write.parquet(path)
    name = "trend_buckets"
    q = ST.trends(ST.observations(feed.event_stream(spark, path))).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < q.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= ST.TREND_BUCKETS + 1
