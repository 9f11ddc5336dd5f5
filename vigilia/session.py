"""Spark session helpers.

Library functions never create sessions; they take DataFrames. These helpers are
for tests, the benchmark and command-line use. On a cluster the session comes
from the launcher and only missing settings are filled in.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job wants; applied only when the session does not set them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Fall back from whole-stage codegen when a generated method exceeds the JVM's JIT limit (8000 bytes of
    # bytecode); above it HotSpot interprets the method and wide text projections run several times slower.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vigilia") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("VIGILIA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.ansi.enabled", "false")
        # small local inputs: let AQE keep enough shuffle partitions to use every core
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (HDFS/object store) folder and is
    used as is. Only when it is unset (local tests) a scratch folder is made.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) for this cluster")
        current = tempfile.mkdtemp(prefix="vigilia-ckpt-")  # local runs and tests only
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Fill in job defaults that the cluster session leaves unset."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint(df):
    """Materialise ``df`` in the shared checkpoint folder (``spark.checkpoint.dir``) and cut its lineage.

    Used for small aggregated tables that several jobs read (so the upstream runs
    once) and survives executor loss, unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
