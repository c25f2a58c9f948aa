"""Shared plumbing: table reading, durable intermediate tables, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000  # documents in an Arrow batch, unless the session asks for fewer: whole texts are held a batch at a time
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and bound the rows of the session's Arrow batches."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="inkwell-"), "inkwell_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a fresh one only where it is unset in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="inkwell-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/inkwell/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application's operators have written to the shared folder; frames that read them end."""
    _delete(spark, _own_dir(spark))


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread, not a recomputation.

    ``drop`` removes those that later tables no longer need; the last ones stay, as the returned frame reads them, until
    ``clear`` is called once the application has used its results.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back. Its shuffle files go as soon as it is written: nothing needs them again."""
        was = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.unset(_CLEANUP) if was is None else self.spark.conf.set(_CLEANUP, was)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def meet(rows: DataFrame, keys: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys``: one row for each value of ``on``, with ``n``, the number of ``rows`` that have it.

    A value with more than a quarter of a partition's even share of the rows is hot. At most four times as many values
    as partitions are, so they are broadcast; the rows of each are dealt by ``spread`` over as many parts as it fills,
    and its key stands in each part. ``keys`` is read twice: a written table. Values in ``on`` aren't null.
    """
    slots = 4 * partitions(rows.sparkSession)
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(keys.where(F.col("n") * slots > total).select(*on, F.ceil(F.col("n") * slots / max(total, 1)).cast("long").alias("_parts")))
    dealt = rows.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)))
    stood = keys.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1)))
    return dealt.drop("_parts").join(stood.drop("_parts", "n"), [*on, "_part"], how).drop("_part")
