"""Folders for intermediate tables, in the shared folder that the cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new name in spark.checkpoint.dir. Where that is unset, a local folder, and only if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/') if base else os.path.join(tempfile.gettempdir(), 'scratch')}/{uuid.uuid4().hex}"
