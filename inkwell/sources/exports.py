"""Session and audit exports, and question batches from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def export_rows(rows: DataFrame, columns: list[str], rest: bool = False, joiner: str = " | ") -> DataFrame:
    """``columns`` in this order, null where ``rows`` lacks one, then other ones if ``rest``; lists become joined text. Columns that begin with _ stay out."""
    have = rows.columns
    more = [c for c in have if c not in columns and not c.startswith("_")] if rest else []
    text = lambda c: F.array_join(c, joiner).alias(c) if isinstance(rows.schema[c].dataType, ArrayType) else F.col(c)
    return rows.select(*[text(c) if c in have else F.lit(None).cast("string").alias(c) for c in [*columns, *more]])


def export(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write as CSV with a header or as JSON lines; any other format name means CSV."""
    if fmt.lower() == "json":
        rows.write.mode("errorifexists").json(path, ignoreNullFields=False)
    else:
        rows.write.mode("errorifexists").csv(path, header=True, escape='"')


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Rows (question) of a text file: of .csv the first field without quotes and without a heading ``question``; else each line that is not blank."""
    lines = spark.read.text(path).select(F.trim("value").alias("q"))
    if path.endswith(".csv"):
        quoted = F.regexp_extract("q", r'^"((?:[^"]++|"")*+)"', 1)
        first = F.when(F.col("q").startswith('"'), F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(F.substring_index("q", ",", 1))
        lines = lines.select(F.trim(first).alias("q")).where("lower(q) <> 'question'")
    return lines.where("q <> ''").withColumnRenamed("q", "question")
