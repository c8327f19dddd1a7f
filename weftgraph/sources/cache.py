"""Caches of extracted rows: a table by content hash, split into hits and misses, appended to, and cleared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.files import decoded, file_hash


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if _exists(spark, path) else None


def clear(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows with their hash; Spark's committer renames whole files, so a lost task leaves nothing half written."""
    rows.withColumn("prefix", F.substring("hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def through(files: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of files (path, content) from the cache where it has a file's hash, extracted and written back where not.

    extract gets (path, text) and returns rows with a path.  Rows that were
    cached for a file of the same content and path are the same by then.
    """
    spark = files.sparkSession
    keyed = files.select("path", "content", file_hash(F.col("content"), F.col("path")).alias("hash"))
    have = read(spark, path)
    missed = keyed if have is None else keyed.join(have.select("hash").distinct(), "hash", "left_anti")
    fresh = extract(missed.select("path", decoded(F.col("content")).alias("text"))).join(missed.select(F.col("path").alias("_p"), "hash"), F.col("path") == F.col("_p")).drop("_p")
    append(fresh, path)
    return read(spark, path).join(keyed.select("hash"), "hash", "left_semi").drop("hash", "prefix")


def split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached rows of these files, files without any) of a cache that is kept by source_file and hash."""
    keyed = files.select("path", file_hash(F.col("content"), F.col("path")).alias("hash"))
    hits = cache.join(keyed.select(F.col("hash")), "hash", "left_semi")
    return hits, keyed.join(cache.select("hash").distinct(), "hash", "left_anti")


def keep_semantic(rows: DataFrame, files: DataFrame, path: str) -> None:
    """Adds a model's rows to the cache, under the hash of the file that each names as source_file; rows of other files are left."""
    keyed = files.select(F.col("path").alias("source_file"), file_hash(F.col("content"), F.col("path")).alias("hash"))
    append(rows.join(keyed, "source_file"), path)
