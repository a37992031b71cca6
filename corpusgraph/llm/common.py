"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Java regex: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session, which is one machine,
    makes a folder of its own, and a cluster, whose executors don't see the driver's folders, is refused."""
    sc = spark.sparkContext
    set_to = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not set_to:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(set_to)
    return set_to.rstrip("/")


_stage: dict = {"id": None}


def begin() -> None:
    """Called first by each task that runs Python here: what tasks of another stage left in this worker is dropped, so a
    worker that serves many stages holds the tables of one."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _stage["id"]:
        _stage.clear()
        _stage["id"] = stage


def held(name: str, make: Callable):
    """What make() gives, kept in this worker for the tasks of the running stage."""
    begin()
    if name not in _stage:
        _stage[name] = make()
    return _stage[name]


def stored(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: the lineage ends there, and a lost executor costs no
    earlier stage."""
    path = f"{shared_dir(df.sparkSession)}/corpusgraph/{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for these tables, once nothing that is still to be computed reads them."""
    for df in tables:
        spark, path = df.sparkSession, df._stored_at
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Python workers find this package also where the driver got it by sys.path alone."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) alone, a null text as the empty one: what else docs carries, under whatever name, can't clash."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
