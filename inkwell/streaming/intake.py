"""Streams into growing tables: new documents are registered once, audit entries get rising numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException


def _there(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def appended(batch: DataFrame, batch_id: int, path: str, number: str) -> None:
    """Append a batch as its own partition, its rows numbered past all before; done again, it replaces itself. Numbers rise, with gaps."""
    numbered = batch.coalesce(64).withColumn(number, F.lit(batch_id).cast("long") * (1 << 40) + F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def register_documents(stream: DataFrame, path: str, checkpoint: str, dims: int, key: str = "doc_id") -> StreamingQuery:
    """Append new documents (key, label, embedding) to the registry; known ids and labels are left out, a vector of another length is an error."""
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.where(F.size("embedding") != dims).limit(1).count():
            raise ValueError(f"vectors of the registry have {dims} numbers")
        known = _there(spark, path, schema).where(F.col("batch") != batch_id)
        new = batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")
        taken = known.select("label").distinct()
        new = new.join(taken.withColumn("taken", F.lit(True)), "label", "left")
        new = new.withColumn("label", F.when(F.col("taken"), F.concat_ws(" ", "label", F.concat(F.lit("("), F.col(key).cast("string"), F.lit(")")))).otherwise(F.col("label")))
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_audit(stream: DataFrame, path: str, checkpoint: str, lists: tuple[str, ...] = ()) -> StreamingQuery:
    """Append audit entries with rising ``entry_id``; list columns are joined by " | "."""

    def write(batch: DataFrame, batch_id: int) -> None:
        x = batch.withColumns({c: F.array_join(c, " | ") for c in lists}) if lists else batch
        appended(x, batch_id, path, "entry_id")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
