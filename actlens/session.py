"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Defaults for tests and the local bench, set on a local master alone.
_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    # Dimension tables of this package are tiny literal tables; data tables
    # never rely on auto-broadcast beyond this bound.
    "spark.sql.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "actlens") -> SparkSession:
    """The active session as it is, one as spark-submit has set it up, or a new local one with local defaults."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName(app)
        submitted = "PYSPARK_GATEWAY_PORT" in os.environ
        master = master or os.environ.get("ACTLENS_MASTER") or (None if submitted else "local[*]")
        if master:
            builder = builder.master(master)
            if master.startswith("local"):
                for key, value in _LOCAL_CONF.items():
                    builder = builder.config(key, value)
        spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared folder there).  Only when it is unset on a local master -- tests
    -- a scratch folder is created and registered; elsewhere executors would
    write to disks of their own, so an unset folder is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="actlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def is_local(master: str) -> bool:
    return master.split("[")[0] == "local"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    token = os.urandom(6).hex()
    return f"{base}/{name}-{token}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_parallel(df: DataFrame) -> DataFrame:
    """Spread CPU-heavy row work over the cluster when the scan is too coarse.

    A Parquet file with one row group is one scan task; the text work that
    follows (regexes over whole documents) would then run on one core.  The
    check is a planning-time partition count, so large inputs -- already
    split into many tasks -- pay nothing.  A coarse input is spread once and
    written to the shared folder: a plain ``repartition`` would not be
    enough, because Catalyst pushes (expensive) filters below it, back into
    the single scan task.
    """
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return materialize(df.repartition(target), "spread")
    return df


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the plan runs once, lineage is cut, and a lost executor re-reads
    files instead of recomputing the stage.  ``partition_by`` lays the table
    out in directories so equality filters on those columns prune files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.parquet(path)
    return out.select(*df.columns) if partition_by else out
