"""Shared storage for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: as the cluster names it, else as the application set it.

    Only a local session without either gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Compute once into a parquet table in shared storage: for tables of which later steps read some columns.

    What the job shuffled goes as soon as the table is written; nothing reads it again.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; the copy lies in shared storage and survives lost executors.

    For small tables such as models, and for the state of loops.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
