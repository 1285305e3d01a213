"""Cutting a plan's lineage where steps build on each other many times over."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a private one only where that is unset and all runs on this machine."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="canopy-"))


def settled(df: DataFrame) -> DataFrame:
    """df, worked out now and kept in the session's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    held = df.persist()  # a checkpoint alone works everything out twice
    try:
        return held.checkpoint()
    finally:
        held.unpersist()


def tidied(df: DataFrame) -> DataFrame:
    """df, settled, and what it was worked out by collected: executors keep a plan's shuffle files as long as the driver holds it."""
    held = settled(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return held
