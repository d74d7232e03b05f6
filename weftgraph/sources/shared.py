"""The folder that driver and executors share, and tables that end a lineage there."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that frees the shuffle files of an execution as soon as it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names. Only where it names none and runs on one machine (tests) it is a local one;
    a cluster that names none is refused, as its executors would not see each other's files."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("the session names no spark.checkpoint.dir, the folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"weftgraph-tables-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


_WRITTEN: list[tuple[SparkSession, str]] = []


def _forget() -> None:
    for spark, path in _WRITTEN:
        try:
            drop_settled(spark, path)
        except (Py4JError, ConnectionError, AttributeError):  # the session is gone: its tables stay in the shared folder
            return


atexit.register(_forget)


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """df, computed once, written as Parquet into the shared folder and read back: lineage ends there for any executor.

    Joins of the table are merge joins: compressed, tables look small to Spark, which would send them whole to the driver."""
    return settled(df, name)[0]


def settled(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """settle() and where the table is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path).hint("merge"), path


def drop_settled(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(rows: DataFrame, by: str) -> DataFrame:
    """rows, dealt over all cores: a table of one file and row group is one task, however much is made of its rows.

    Settled, as Spark would else do what later filters ask for before the rows are dealt out, in that one task."""
    return settle(rows.repartition(4 * max(rows.sparkSession.sparkContext.defaultParallelism, 1), by), "spread")
