"""What the operators of this subpackage share: texts, shared files, hashes and connected components."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
#: Spark's setting that frees the shuffle files of an execution as soon as it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_of(name: str = "text") -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and runs on one machine (tests)
    it is a local one; a cluster that names none is refused, as its executors would not see each other's files."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("the session names no spark.checkpoint.dir, the folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"weftgraph-shared-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


_WRITTEN: list[tuple[SparkSession, str]] = []


def _forget() -> None:
    for spark, path in _WRITTEN:
        try:
            drop_written(spark, path)
        except (Py4JError, ConnectionError, AttributeError):  # the session is gone: its tables stay in the shared folder
            return


atexit.register(_forget)


def drop_written(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, for any executor. The
    shuffles behind the table are freed as soon as it is whole."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """materialise() and where the table is."""
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
    return spark.read.schema(df.schema).parquet(path), path


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: two bigint columns. Returns (node, label) for every node on an edge, label being the smallest
    node of its component. Least neighbours are summed before they are dealt out, since min() is combined in each map
    task, and written before they are joined: a join that reads tables only is split where one node, such as the hub
    of a whole component, has most of the rows. Null ends and loops are dropped.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now, place = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: what is larger than v hangs on the least around v, v itself where it has no smaller neighbour
        low, low_place = written(now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "low")
        large, large_place = written(now.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large")
        # small star: u and what is smaller than it hang on the least of them
        least, least_place = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = place
        now, place = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        for path in (last, low_place, large_place, least_place):
            drop_written(spark, path)  # the new stars are whole, nothing reads these again
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return materialise(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "components")


def concat_ids(ids: list[bytes]) -> bytes:
    return b"".join(ids)
