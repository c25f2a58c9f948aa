"""Folders that outlive a task: the shared one of the session, and appends that readers see whole or not at all."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a fresh one of this machine only where that is unset in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet rows under ``path`` with the given columns; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
