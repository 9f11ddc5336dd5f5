"""File sources and sinks (A1, A5, A6 metadata, A9).

Reads take an explicit schema (no inference pass over the data); a flat file's
line order is attached at ingest as ``line_no`` so later keyless steps (stay
rebuild) have an explicit order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clinical import nan_to_null
from ..session import checkpoint

# Schema of the raw observation file.
OBSERVATION_SCHEMA = (
    "hour_from_admission long, heart_rate double, respiratory_rate double, spo2_pct double, temperature_c double, "
    "systolic_bp double, diastolic_bp double, oxygen_device string, oxygen_flow double, mobility_score long, "
    "nurse_alert int, wbc_count double, lactate double, creatinine double, crp_level double, hemoglobin double, "
    "age long, gender string, comorbidity_index long, admission_type string, sepsis_risk_score double, "
    "deterioration_next_12h int"
)


CORRUPT = "_corrupt_record"
SPLITS = 100_000  # splits whose offsets are broadcast (one narrow row each)


def read_observations_csv(spark: SparkSession, path: str, schema: str = OBSERVATION_SCHEMA,
                          with_line_no: bool = True, corrupt: str | None = None) -> DataFrame:
    """A1: CSV with header and an explicit schema; NaN text is read as NULL.

    ``line_no`` is 1..N over all files in order of their paths (see :func:`numbered`). ``corrupt`` names a column that
    holds the text of a malformed line (its unreadable fields are NULL) and NULL for others.
    """
    fields = f"{schema}, {CORRUPT} string"
    df = spark.read.schema(fields).option("header", True).option("nanValue", "NaN").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    # a field that nobody reads is not parsed: the mark of a malformed line depends on all fields, so that all are
    whole = F.xxhash64(*[c for c in df.columns if c != CORRUPT]) >= F.lit(-(1 << 63))
    df = df.select(*[c for c in df.columns if c != CORRUPT], *([F.when(whole, F.col(CORRUPT)).alias(corrupt)] if corrupt else []), *_place())
    df = nan_to_null(df)
    return numbered(df) if with_line_no else df.drop("_file", "_start", "_pos")


def _place() -> list[Column]:
    """A row's file, the start of its split in the file, and its place in the task that reads it."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_pos")]


def numbered(df: DataFrame, out: str = "line_no") -> DataFrame:
    """Line numbers without a sort: rows are counted per split (file, start), a running sum over the splits in order of
    path and start gives each split's offset, and a row's number is the offset and its place in the split.

    The table of splits (one row each) is written once in the shared checkpoint folder, and broadcast up to ``SPLITS`` rows;
    the rows themselves stay in the tasks that read them. Both passes read the same splits: a scan's layout depends on the
    files and the session's settings alone.
    """
    splits = df.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    splits = checkpoint(splits.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    if splits.count() <= SPLITS:
        splits = F.broadcast(splits)
    d = df.join(splits, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return d.withColumn(out, (F.col("_off") + F.col("_pos") - F.col("_first") + 1).cast("long")).drop("_file", "_start", "_pos", "_f", "_s", "_first", "_off")


def read_with_quarantine(spark: SparkSession, path: str, schema: str = OBSERVATION_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """A1: (readable rows with ``line_no``, malformed lines as (line_no, line)); numbers count all lines of both."""
    rows = read_observations_csv(spark, path, schema, corrupt="line")
    return rows.filter(F.col("line").isNull()).drop("line"), rows.filter(F.col("line").isNotNull()).select("line_no", "line")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    r = spark.read.format(fmt)
    return (r.schema(schema) if schema else r).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """A5: table sink (processed table, splits by ``partitionBy("split")``, labelled data, comparisons)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def append_predictions(log: DataFrame, path: str) -> None:
    """Append-only prediction log partitioned by day."""
    log.withColumn("dt", F.to_date("ts")).write.mode("append").partitionBy("dt").parquet(path)
