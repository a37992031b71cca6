"""A folder for what a query writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir, which driver and executors share. Where that is unset, a local session, which is
    one machine, takes a temporary folder, and a cluster is refused."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base.rstrip('/')}/corpusgraph/{what}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Python workers find this package also where the driver got it by sys.path alone."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
