"""Cuts of lineage by reliable checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the context's own or the one named in spark.checkpoint.dir.

    A local session without either gets a temporary one; elsewhere that raises, as executors
    couldn't share it.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-cuts-")
        atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the session's checkpoint folder."""
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the session's checkpoint folder from now on."""
    _folder(df.sparkSession)
    return df.checkpoint()


def in_tasks(rows: DataFrame, many: int | None, each: int, *keys: str) -> DataFrame:
    """rows, many of them (null is none), dealt out by their keys to tasks of about each rows, one for each core at least."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-(many or 0) // each)), *keys)
