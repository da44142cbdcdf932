"""Cutting the lineage of tables that are built step by step."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir, which all executors share; where it is unset (tests), in a local one. A cluster
    without that setting is an error, as its machines don't share local folders."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keyflow-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
