"""Per-day partials: a later append reads and rewrites the changed days only and equals the full recomputation."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from paths import SF_MID
from vigilia.operators import monitor as MO
from vigilia.operators import partials as PT
from vigilia.sources import tables as T


def _files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/dt=*/*.parquet")}


def _same(a, b):
    cols = sorted(b.columns)
    return a.count() == b.count() and a.select(cols).exceptAll(b.select(cols)).count() == 0


def _close(a, b):
    """Equal rows; current score, tier, time, list and trend are exact."""
    rows = lambda d: sorted((str(r.patient_id), str(r)) for r in d.select(*sorted(b.columns)).collect())
    return rows(a) == rows(b)


def test_appends_keep_partials_equal_to_the_full_log(spark):
    log = T.prediction_log(T.vitals(spark, SF_MID)).withColumn("patient_id", F.when(F.col("patient_id") % 9 != 0, F.col("patient_id"))).cache()
    path, partial = (f"{tempfile.mkdtemp(prefix='vigilia-log-')}/x" for _ in range(2))
    days = sorted(r[0] for r in log.select(F.to_date("ts")).distinct().collect())
    assert len(days) >= 3
    cut = F.lit(days[1]).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")  # the second day comes in two parts
    seen = log.limit(0)
    for part in (F.col("ts") < cut, F.col("ts") >= cut):
        before = _files(partial)
        changed = set(PT.append_day(log.filter(part), path, partial))
        seen = log.filter(part) if not before else log
        after = _files(partial)
        for f, when in before.items():  # an unchanged day's files stay as they are
            assert (after.get(f) == when) == (f.split("dt=")[1].split("/")[0] not in {str(d) for d in changed})
        rows = spark.read.parquet(partial)
        assert _same(PT.summary(rows), MO.system_summary(seen))
        assert _same(PT.current_risk(rows), MO.current_risk(seen))
        kept = spark.read.parquet(path)
        for hot in (MO.S.HOT_ROWS, 5):
            assert _close(PT.history(rows, kept, hot_rows=hot), MO.patient_history(seen))
            assert _close(PT.history(rows, kept, keep_last=3, hot_rows=hot), MO.patient_history(seen, keep_last=3))
    assert days[0] not in changed and days[1] in changed
    need = PT.history_days(spark.read.parquet(partial), keep_last=3)
    most = need.filter("in_log").groupBy("patient_id").count().agg(F.max("count")).first()[0]
    assert need.filter("NOT in_log").count() > 0 and most <= 5  # two cut days, and those of three rows
    PT.refresh(spark, path, partial, [days[1]])  # again: nothing changes
    assert _same(PT.summary(spark.read.parquet(partial)), MO.system_summary(log))
    plan = PT.day_partials(spark.read.parquet(path).filter(F.col("dt").isin([days[1]])))._jdf.queryExecution().executedPlan().toString()
    assert "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    log.unpersist()
