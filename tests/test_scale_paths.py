"""Skew and keyless paths give the same rows as the plain single-partition forms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from paths import SF_MID
from vigilia.functions import clinical as C
from vigilia.operators import explain as X
from vigilia.operators import features as FE
from vigilia.operators import labels as L
from vigilia.operators import prefix
from vigilia.operators import sequence as S
from vigilia.sources import tables as T


def _pdf(df, cols, key="obs_id"):
    return df.select(*cols).toPandas().sort_values(key).reset_index(drop=True)


def test_hot_key_split_equals_plain(spark):
    plain = T.vitals_from_events(T.table(spark, SF_MID, "events"), hot_rows=None)
    hot = T.vitals_from_events(T.table(spark, SF_MID, "events"), hot_rows=40)  # most patients become "hot"
    assert hot.count() == plain.count()
    a = L.label_future_sepsis(C.with_sirs(plain), hot_rows=None)
    b = L.label_future_sepsis(C.with_sirs(hot), hot_rows=40)
    ta = FE.trend_features(a, hot_rows=None)
    tb = S.sequence_windows(b, "patient_id", ["hour_from_admission", "obs_id"],
                            chunk_basis=F.col("hour_from_admission"), hot_rows=40, hour_chunk=16.0, row_chunk=8,
                            rows_fn=lambda x, p: x.withColumns({
                                "heart_rate_change": F.coalesce(F.col("heart_rate") - F.lag("heart_rate").over(
                                    Window.partitionBy(*p).orderBy("hour_from_admission", "obs_id")), F.lit(0.0)),
                                "lactate_rolling_mean": F.avg("lactate").over(
                                    Window.partitionBy(*p).orderBy("hour_from_admission", "obs_id").rowsBetween(-2, 0))}),
                            rows_back=2)
    cols = ["obs_id", "hour_from_admission", "sepsis_next_6h", "heart_rate_change", "lactate_rolling_mean"]
    pa, pb = _pdf(ta, cols), _pdf(tb, cols)
    assert (pa.fillna(-1) == pb.fillna(-1)).all().all()


def test_top_k_hot_equals_plain(spark):
    v = T.vitals(spark, SF_MID, hot_rows=None)
    order = [F.col("hour_from_admission").desc(), F.col("obs_id").desc()]
    a = S.top_k_per_key(v, "patient_id", order, 12, hot_rows=None)
    b = S.top_k_per_key(v, "patient_id", order, 12, chunk_basis=F.col("hour_from_admission"), hot_rows=30,
                        hour_chunk=10.0)
    pa, pb = _pdf(a, ["obs_id", "rank"]), _pdf(b, ["obs_id", "rank"])
    assert len(pa) == 150 * 12 and (pa == pb).all().all()


def test_prefix_row_number_and_running_sums(spark):
    v = T.vitals(spark, SF_MID)
    rn = prefix.global_row_number(v, ["patient_id", "hour_from_admission"], "rn", n=7).select("rn").toPandas()
    assert sorted(rn.rn) == list(range(1, 10001))
    rs = prefix.running_sums(v.select("obs_id", F.lit(1).alias("one")), ["obs_id"], ["one"], n=5)
    p = rs.toPandas().sort_values("obs_id")
    assert list(p.one_cum) == list(range(1, len(p) + 1))


def test_label_equi_join_form_equals_window(spark):
    v = T.vitals(spark, SF_MID)
    a = _pdf(L.label_future_sepsis(v), ["obs_id", "sepsis_next_6h"])
    b = _pdf(L.label_future_sepsis_join(v), ["obs_id", "sepsis_next_6h"])
    assert (a == b).all().all() and a.sepsis_next_6h.sum() == 2121  # FIXTURES.md: 2,121 positives at sf0.01


def test_factor_ranking_is_row_local(spark):
    w = T.impacts_wide(T.vitals(spark, SF_MID))
    plan = X.ranked_long(w, "factors", k=10)._jdf.queryExecution().executedPlan().toString()
    # the only Exchange is the one of the vitals ordinal window, ranking adds none
    assert plan.count("Exchange") <= 1


def test_forward_fill_hot_equals_plain(spark):
    v = T.vitals(spark, SF_MID)
    cols = ["lactate", "temperature_c", "hemoglobin"]
    a = _pdf(FE.forward_fill(v, cols, hot_rows=None), ["obs_id", *cols])
    b = _pdf(FE.forward_fill(v, cols, hot_rows=30, hour_chunk=8.0), ["obs_id", *cols])
    assert (a.fillna(-1) == b.fillna(-1)).all().all()


def _with_null_patients(v):
    """Every third patient's id is NULL: one patient, with many rows; hours made distinct again."""
    return v.withColumn("patient_id", F.when(F.col("patient_id") % 3 != 0, F.col("patient_id"))).withColumn("hour_from_admission", F.col("obs_id") % 5000)


def test_null_patients_are_one_patient_in_hot_and_plain_paths(spark):
    from vigilia.operators import monitor as M
    v = _with_null_patients(T.vitals(spark, SF_MID)).cache()
    n = v.filter("patient_id is null").count()
    assert n > 1000
    cols = ["lactate", "temperature_c", "hemoglobin"]
    a = _pdf(FE.forward_fill(v, cols, hot_rows=None), ["obs_id", *cols])
    b = _pdf(FE.forward_fill(v, cols, hot_rows=200, hour_chunk=100.0), ["obs_id", *cols])
    assert len(a) == v.count() and (a.fillna(-1) == b.fillna(-1)).all().all()
    a = _pdf(M.with_position(v, hot_rows=None), ["obs_id", "_r", "_n"])
    b = _pdf(M.with_position(v, hot_rows=200), ["obs_id", "_r", "_n"])
    assert (a == b).all().all() and (a["_n"] == n).sum() == n
    a = _pdf(L.label_future_sepsis(v), ["obs_id", "sepsis_next_6h"])
    b = _pdf(L.label_future_sepsis_join(v), ["obs_id", "sepsis_next_6h"])
    assert (a == b).all().all() and len(a) == v.count()
    for hot in (None, 200):
        s = M.monitoring_summary(v, hot_rows=hot).filter("patient_id is null").collect()
        assert len(s) == 1 and s[0].total_data_points == 24
    log = v.select("patient_id", "obs_id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour_from_admission").cast("int"))).alias("ts"),
                   F.lit("m").alias("model_used"), F.col("score_b").alias("risk_score"), F.lit("LOW").alias("risk_level"))
    one, two = (M.patient_history(log, hot_rows=hot).orderBy("patient_id").collect() for hot in (None, 200))
    assert one == two and one[0].patient_id is None and one[0].n_points == n and len(one[0].predictions) == 24
    plan = M.patient_history(log, hot_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    v.unpersist()


def test_prepare_job_has_one_shuffle(spark):
    from vigilia.plans import prepare as PR
    d = PR.prepared_table(T.vitals(spark, SF_MID))
    plan = d._jdf.queryExecution().executedPlan().toString()
    # one hash Exchange on the patient key feeds the ordinal, label and trend windows
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window") >= 3


def test_hourly_rolling_hot_equals_plain(spark):
    v = T.vitals(spark, SF_MID)
    cols = ["obs_id", "heart_rate_mean_4h", "heart_rate_slope_4h"]
    a = _pdf(FE.hourly_rolling(v, "heart_rate", 4, hot_rows=None), cols)
    b = S.sequence_windows(
        v, "patient_id", ["hour_from_admission", "obs_id"], chunk_basis=F.col("hour_from_admission"), hot_rows=30,
        hour_chunk=5.0, range_back=3,
        range_fn=lambda x, p: x.withColumns({
            "heart_rate_mean_4h": F.avg("heart_rate").over(
                Window.partitionBy(*p).orderBy("hour_from_admission").rangeBetween(-3, 0)),
            "heart_rate_slope_4h": F.regr_slope(F.col("heart_rate"), F.col("hour_from_admission").cast("double")).over(
                Window.partitionBy(*p).orderBy("hour_from_admission").rangeBetween(-3, 0))}))
    pb = _pdf(b, cols)
    assert len(a) == len(pb) == 10000
    assert ((a.fillna(0) - pb.fillna(0)).abs().max(numeric_only=True) < 1e-9).all()


def _with_nulls(spark, n=4000):
    """Observations with NULL keys, NULL hours, ties and one large key."""
    return spark.range(n).selectExpr(
        "id AS obs_id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 = 0 THEN 1 ELSE id % 17 END AS patient_id",
        "CASE WHEN id % 23 = 0 THEN NULL ELSE CAST(floor(id / 6) AS BIGINT) END AS hour_from_admission",
        "CAST(id * 37 % 101 AS DOUBLE) AS x")


def _all_windows(df, hot_rows):
    def rng(d, parts):
        w = Window.partitionBy(*parts).orderBy("hour_from_admission")
        return d.withColumn("back", F.sum("x").over(w.rangeBetween(-3, 0))).withColumn("ahead", F.max("x").over(w.rangeBetween(1, 6)))

    def rows(d, parts):
        w = Window.partitionBy(*parts).orderBy("hour_from_admission", "obs_id")
        return d.withColumn("was", F.lag("x").over(w)).withColumn("six", F.lead("x", 6).over(w)).withColumn("m3", F.avg("x").over(w.rowsBetween(-2, 0)))

    return S.sequence_windows(df, "patient_id", ["hour_from_admission", "obs_id"], chunk_basis=F.col("hour_from_admission"),
                              range_fn=rng, rows_fn=rows, range_back=3, range_fwd=6, rows_back=2, rows_fwd=6, seq_col="seq",
                              hot_rows=hot_rows, hour_chunk=16.0, row_chunk=16)


def test_null_keys_and_hours_survive_the_hot_path(spark, monkeypatch):
    df = _with_nulls(spark)
    cols = ["obs_id", "patient_id", "hour_from_admission", "seq", "back", "ahead", "was", "six", "m3"]
    want = _pdf(_all_windows(df, None), cols).astype(float).fillna(-1)
    assert len(want) == 4000
    for hot_rows, most in ((1000, 10_000), (300, 10_000), (20, 10_000), (20, 0)):  # some keys hot, all hot, join form
        monkeypatch.setattr(S, "HOT_LIST_MAX", most)
        monkeypatch.setattr(S, "_HOT_CACHE", {})
        got = _pdf(_all_windows(df, hot_rows), cols).astype(float).fillna(-1)
        assert len(got) == 4000 and (got == want).all().all(), (hot_rows, most)


def test_top_k_keeps_null_keys_and_hours(spark):
    df = _with_nulls(spark)
    order = [F.col("hour_from_admission").desc(), F.col("obs_id").desc()]
    a = _pdf(S.top_k_per_key(df, "patient_id", order, 12, hot_rows=None), ["obs_id", "rank"])
    b = _pdf(S.top_k_per_key(df, "patient_id", order, 12, chunk_basis=F.col("hour_from_admission"), hot_rows=100, hour_chunk=10.0), ["obs_id", "rank"])
    assert (a == b).all().all()


def test_ordinary_rows_keep_one_scan_beside_a_hot_key(spark):
    v = T.vitals_from_events(T.table(spark, SF_MID, "events"))
    plain = L.label_future_sepsis(C.with_sirs(v))._jdf.queryExecution().executedPlan().toString()
    assert plain.count("FileScan") == 1
    df = _with_nulls(spark)
    plan = S.sequence_windows(df, "patient_id", ["hour_from_admission"], chunk_basis=F.col("hour_from_admission"),
                              seq_col="seq", hot_rows=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 3  # ordinary rows, hot rows, and the hot chunks' counts


def test_stays_start_at_null_hours_on_any_bucket_size(spark):
    from vigilia.operators import stays as ST
    hours = [0, 1, None, 2, 0, 0, 3, None, None, 5, 4, 4, 9]
    df = spark.createDataFrame([(i + 1, h) for i, h in enumerate(hours)], "line_no long, hour_from_admission long")
    prev, n, want = None, 0, []
    for i, h in enumerate(hours):
        n += i == 0 or h is None or prev is None or h < prev
        prev = h
        want.append(n)
    assert want[:5] == [1, 1, 2, 3, 4]
    for size in (1, 2, 5, 100):
        out = prefix.lag_scan_new_groups(df, "line_no", "hour_from_admission", "f", "g", dense=True, lines_per_bucket=size)
        assert [r.g for r in out.orderBy("line_no").collect()] == want
    out = ST.rebuild_stays(df, dense_lines=False, n_parts=4)
    assert [r.patient_id for r in out.orderBy("line_no").collect()] == want


def test_medians_count_a_frequent_value_once(spark):
    from vigilia.operators import profile as P
    df = spark.range(10000).selectExpr("CASE WHEN id % 10 < 9 THEN 5.0 ELSE CAST(id AS DOUBLE) END AS a", "CAST(id AS DOUBLE) AS b")
    counts = df.groupBy("a").count()
    assert counts.count() == 1001  # what the running sums get, instead of 10,000 rows
    got = {r.feature: r["median"] for r in P.exact_quantiles(df, ["a", "b"]).collect()}
    assert got == {"a": 5.0, "b": 4999.5}
    ranges = prefix.ranged(counts.select(F.lit("a").alias("feature"), F.col("a").alias("value")), ["feature", "value"], 8)
    assert ranges.groupBy("_pid").count().agg(F.max("count")).first()[0] < 3 * 1001 / 8
