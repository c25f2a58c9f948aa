"""Documents as files: pages and positioned lines by an injected parser, manifests, caches of parsed text and of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: From a file's bytes, its lines as (page, line number, x or -1, text).
Parser = Callable[[bytes], list[tuple[int, int, float, str]]]
Embed = Callable[[list[str]], list[list[float]]]


def scanned(spark: SparkSession, paths: list[str], parser: Parser, suffix: str = ".pdf") -> DataFrame:
    """Rows (path, modified, page, line_no, x, line) of the files under ``paths``, parsed where they are read.

    Paths that aren't there, and files that go meanwhile, are left out; a file that the parser fails on gives one row
    with a null line. No paths give no rows.
    """
    schema = "path string, modified timestamp, page long, line_no long, x double, line string"
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(hadoop).exists(p)

    paths = [p for p in paths if there(p)]
    if not paths:
        return spark.createDataFrame([], schema)
    read = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(paths)

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, when, content in part.itertuples(index=False):
                try:
                    rows = [(path, when, *r) for r in parser(bytes(content))]
                except Exception:  # whatever a parser raises on a broken file
                    rows = [(path, when, 0, 0, -1.0, None)]
                yield pd.DataFrame(rows, columns=["path", "modified", "page", "line_no", "x", "line"])

    return read.select("path", "modificationTime", "content").mapInPandas(parse, schema)


_MANIFEST = "path string, fingerprint string, cache string"


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all versions of a manifest; none where it isn't there."""
    try:
        return spark.read.schema(f"{_MANIFEST}, version long").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{_MANIFEST}, version long")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, fingerprint, cache) of the last version of a manifest; none where it isn't there."""
    x = _versions(spark, path)
    last = x.agg(F.max("version").alias("version"))
    return x.join(F.broadcast(last), "version").where("path is not null").drop("version")  # one row


def write_manifest(entries: DataFrame, path: str) -> None:
    """Append ``entries`` as a new version; a crash before it is committed leaves the one before. They may come from the manifest itself.

    A row without a path marks each version, so that one may be empty.
    """
    spark = entries.sparkSession
    last = _versions(spark, path).agg(F.max("version")).first()[0]
    none = F.lit(None).cast("string")
    mark = spark.range(1).select(none.alias("path"), none.alias("fingerprint"), none.alias("cache"))
    x = entries.select("path", "fingerprint", "cache").unionByName(mark).withColumn("version", F.lit(0 if last is None else last + 1).cast("long"))
    x.write.mode("append").json(path)


def write_parsed(lines: DataFrame, folder: str) -> None:
    """The parse cache: a partition for each fingerprint, replaced when it is written again."""
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(folder)


def read_parsed(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Cached lines of the ``wanted`` fingerprints; only their partitions are read."""
    return spark.read.parquet(folder).join(wanted.select("fingerprint").distinct(), "fingerprint", "left_semi")


def embedded(chunks: DataFrame, cache: DataFrame, embed: Embed, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``chunks`` with their vectors, and the rows (text_sha, embedding) to append to ``cache``: texts that it doesn't hold, once each.

    The key is the text's own hash, so a changed text is never given an old vector.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["embedding"] = embed(part["t"].tolist())
            yield part[["text_sha", "embedding"]]

    keyed = chunks.withColumn("text_sha", F.sha2(F.col(text), 256))
    missing = keyed.select("text_sha", F.col(text).alias("t")).where("t is not null").dropDuplicates(["text_sha"]).join(cache, "text_sha", "left_anti")
    new = missing.mapInPandas(run, "text_sha string, embedding array<double>")
    return keyed.join(cache.select("text_sha", "embedding").unionByName(new), "text_sha", "left"), new
