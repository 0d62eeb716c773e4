"""The folder that driver and executors share, for tables that are written and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only where that is unset, and the session local, below a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
        base = f"file://{tempfile.mkdtemp(prefix='attriva-')}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
