"""Files as rows: path (relative) and text. A null text is a file that could not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


class StreamTooLong(ValueError):
    """A file has more bytes than the reader takes."""


def walk(spark: SparkSession, root: str, keep: Column | None = None) -> DataFrame:
    """path and length of every file below root whose name paths.valid() takes; no file is opened for it.

    keep: a predicate on `path`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return _relative(spark, root, found, keep)


def read_files(spark: SparkSession, root: str, keep: Column | None = None, most_bytes: int | None = None) -> DataFrame:
    """path and text of the files below root. Files over most_bytes stop the read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "content")
    rows = _relative(spark, root, found, keep)
    content = F.col("content")
    if most_bytes is not None:
        content = F.when(F.col("length") <= most_bytes, content).otherwise(F.raise_error(F.concat(F.lit("StreamTooLong: "), F.col("path"))).cast("binary"))
    return rows.select("path", content.cast("string").alias("text"))


def _relative(spark: SparkSession, root: str, found: DataFrame, keep: Column | None) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/"
    bare = lambda p: F.regexp_replace(p, "^[a-z]+:/+", "/")  # noqa: E731  one slash or three after the scheme
    prefix = F.length(bare(F.lit(full)))
    rows = found.withColumn("path", F.substring(bare(F.col("path")), prefix + 1, F.length("path")))
    rows = rows.where(paths.valid("path"))
    return rows if keep is None else rows.where(keep)


def unread(files: DataFrame) -> DataFrame:
    """Paths that were asked for and came without a text, each once."""
    return files.where(F.col("text").isNull()).select("path").distinct()
