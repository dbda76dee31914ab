"""Session defaults, lineage cutting and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "roadwatch", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator relies on (UTC, AQE, skew join)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # call-site capture costs milliseconds per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without the setting gets a private temporary
    folder; on a cluster a missing setting is an error, because a machine-local
    folder would be lost with its machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    active = sc.getCheckpointDir()
    if configured:
        if active is None:
            sc.setCheckpointDir(configured)
        return configured
    if active:
        return active
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="roadwatch-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable cut for iterative plans: the step is written to the shared folder and read back.

    Unlike a checkpoint of an unpersisted table it is computed once, and the
    next step is planned with the true size. It survives lost executors.
    """
    return stored(df, "step")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
